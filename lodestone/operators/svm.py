"""Support vector machines with kernels, for tables of any size.

Blocks of at most ``block`` rows are solved side by side, each keeps its support vectors, and
those are dealt into blocks again until one block is left, whose solution is the model. Rows of
the whole table that violate its margin then join the support vectors and the cascade runs
again, up to ``passes`` times or until no row does. Rows with a null or NaN in a feature or the
target teach nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import RegressionScore, accuracy


def gram_matrix(name, a: np.ndarray, b: np.ndarray, gamma: float, coef0: float, degree: float) -> np.ndarray:
    """Kernel values of all pairs of rows; ``name`` may be a function of two matrices."""
    if callable(name):
        return name(a, b)
    dot = a @ b.T
    if name == "linear":
        return dot
    if name in ("poly", "polynomial"):
        return (gamma * dot + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if name == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] - 2 * dot + (b * b).sum(1), 0))
    raise ValueError(f"unknown kernel {name!r}")


def solve_dual(k: np.ndarray, rows: np.ndarray, sign: np.ndarray, linear: np.ndarray, c: float, tol: float, steps: int) -> tuple[np.ndarray, float]:
    """Minimises a'Qa / 2 + linear'a with Q_ij = sign_i sign_j k[rows_i, rows_j], 0 <= a <= c and
    sign'a = 0, by the pair of variables that violates optimality most. Returns a and the bias."""
    a, g = np.zeros(len(sign)), linear.astype(float).copy()
    top, bottom = 0.0, 0.0
    for _ in range(steps):
        v = -sign * g
        up, down = np.where(sign > 0, a < c, a > 0), np.where(sign > 0, a > 0, a < c)
        if not up.any() or not down.any():
            break
        i, j = int(np.argmax(np.where(up, v, -np.inf))), int(np.argmin(np.where(down, v, np.inf)))
        top, bottom = v[i], v[j]
        if top - bottom <= tol:
            break
        ri, rj = rows[i], rows[j]
        room = min(c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else c - a[j])
        move = min((top - bottom) / max(k[ri, ri] + k[rj, rj] - 2 * k[ri, rj], 1e-12), room)
        for x, way in ((i, sign[i]), (j, -sign[j])):
            a[x] = min(max(a[x] + way * move, 0.0), c)
            a[x] = 0.0 if a[x] < 1e-14 * c else c if a[x] > c * (1 - 1e-14) else a[x]
        g += sign * (k[rows, ri] - k[rows, rj]) * move
    return a, (top + bottom) / 2


@dataclass
class _Machine:
    columns: list[str]
    target: str
    id_col: str
    kernel: object = "rbf"
    c: float = 1.0
    gamma: float = 0.0  # 0: one by the number of columns
    coef0: float = 0.0
    degree: float = 3.0
    tol: float = 1e-3
    block: int = 2000
    passes: int = 3
    steps: int = 100_000
    vectors: np.ndarray | None = field(default=None, init=False)
    weights: np.ndarray | None = field(default=None, init=False)
    bias: float = field(default=0.0, init=False)

    def _k(self, a, b):
        return gram_matrix(self.kernel, a, b, self.gamma or 1 / len(self.columns), self.coef0, self.degree)

    def _dual(self, x, y) -> tuple[np.ndarray, float]:
        """(weight of each row in the decision, bias)"""
        raise NotImplementedError

    def _violates(self, decision, y):
        raise NotImplementedError

    def _solve(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        x = np.array(pdf["x"].tolist(), float)
        w, bias = self._dual(x, pdf["y"].to_numpy(float))
        return x, w, bias

    def _work(self, df: DataFrame) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in self.columns])
        y = F.col(self.target).cast("double")
        rows = df.select(F.xxhash64(self.id_col).alias("h"), x.alias("x"), y.alias("y"))
        return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull() & ~F.isnan("y"))

    def _cascade(self, rows: DataFrame) -> None:
        solve, kind, turn = self._solve, "h long, x array<double>, y double", 0
        n = rows.count()
        while n > self.block:
            blocks = -(-2 * n // self.block)  # half full on average, so that a hash rarely overfills one

            def support(pdf: pd.DataFrame) -> pd.DataFrame:
                return pdf[["h", "x", "y"]][solve(pdf)[1] != 0]

            kept = rows.groupBy(F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(blocks)).alias("b")).applyInPandas(support, kind)
            rows, before, turn = cut(kept), n, turn + 1
            n = rows.count()
            if n > 0.9 * before:
                raise ValueError(f"{n} of {before} rows are support vectors, more than block={self.block}: raise block, C or gamma don't fit the data")
        final = rows.orderBy("h", "y", "x").toPandas()
        if not len(final):
            self.vectors, self.weights, self.bias, self._ids = np.zeros((0, len(self.columns))), np.zeros(0), 0.0, []
            return
        x, w, self.bias = solve(final)
        used = w != 0
        self.vectors, self.weights, self._ids = x[used], w[used], [int(h) for h in final["h"][used]]

    def fit(self, df: DataFrame):
        work = self._work(df)
        self._cascade(work)
        for _ in range(self.passes - 1):
            if work.count() <= self.block:
                break
            decision, check = self._decision(F.col("x")), self._violates
            judged = work.withColumn("d", decision)
            mine = F.col("h").isin(self._ids) if self._ids else F.lit(False)  # at most ``block`` ids
            wrong = judged.filter(~mine & check(F.col("d"), F.col("y")))
            if not wrong.limit(1).count():
                break
            self._cascade(cut(judged.filter(mine | check(F.col("d"), F.col("y"))).select("h", "x", "y")))
        return self

    def _decision(self, x):
        vectors, weights, bias, k = self.vectors, self.weights, self.bias, self._k

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            if not len(x) or not len(vectors):
                return pd.Series(np.full(len(x), bias), index=x.index)
            return pd.Series(k(np.array(x.tolist(), float), vectors) @ weights + bias, index=x.index)

        return run(x)

    def decision(self, df: DataFrame, name: str = "decision") -> DataFrame:
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])
        whole = F.forall(F.array(*[F.col(c).cast("double") for c in self.columns]), lambda v: v.isNotNull() & ~F.isnan(v))
        return df.withColumn(name, F.when(whole, self._decision(x)))


@dataclass
class SVC(_Machine):
    """Two classes: targets above 0 are positive. predict gives 1.0 or 0.0, null where a feature is missing."""

    def _dual(self, x, y):
        sign = np.where(y > 0, 1.0, -1.0)
        a, bias = solve_dual(self._k(x, x), np.arange(len(y)), sign, -np.ones(len(y)), self.c, self.tol, self.steps)
        return sign * a, bias if len(set(sign)) > 1 else float(sign[0])

    def _violates(self, decision, y):
        return F.when(y > 0, decision).otherwise(-decision) < 1 - 10 * self.tol

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.decision(df, f"{name}_decision").withColumn(name, (F.col(f"{name}_decision") >= 0).cast("double"))

    def score(self, df: DataFrame, weight: str | None = None) -> float:
        """The share of the rows on their side."""
        sides = self.predict(df).withColumn("__side", (F.col(self.target).cast("double") > 0).cast("double"))
        return float(accuracy(sides, "__side", "prediction", weight).first().accuracy)


@dataclass
class SVR(RegressionScore, _Machine):
    """Regression that is indifferent to errors up to ``epsilon``."""

    epsilon: float = 0.1

    def _dual(self, x, y):
        n = len(y)
        rows, sign = np.r_[np.arange(n), np.arange(n)], np.r_[np.ones(n), -np.ones(n)]
        a, bias = solve_dual(self._k(x, x), rows, sign, np.r_[self.epsilon - y, self.epsilon + y], self.c, self.tol, self.steps)
        return a[:n] - a[n:], bias

    def _violates(self, decision, y):
        return F.abs(decision - y) > self.epsilon + 10 * self.tol

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.decision(df, name)


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, under spark.checkpoint.dir; cached where it is unset."""
    sc = df.sparkSession.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        return df.persist()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return df.checkpoint()
