"""Scalers, imputers, encoders and discretisers: one aggregate to fit, one projection to
transform. A fitted operator holds a few numbers a column; NaN and null are both missing."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import most_frequent, quantiles


def present(c: str) -> Column:
    """The column as a double, missing values as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


class Operator:
    """fit(df) learns, expressions() gives the new columns, transform(df) applies them."""

    def fit(self, df: DataFrame) -> Operator:
        return self

    def expressions(self, columns: list[str]) -> dict[str, Column]:
        raise NotImplementedError

    def inverse_expressions(self, columns: list[str]) -> dict[str, Column]:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.expressions(df.columns))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.inverse_expressions(df.columns))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class _Affine(Operator):
    """x -> (x - shift) / scale, a fitted pair a column."""

    columns: list[str]
    shift: dict[str, float] = field(default_factory=dict, init=False)
    scale: dict[str, float] = field(default_factory=dict, init=False)

    def statistics(self, x: Column) -> list[Column]:
        raise NotImplementedError

    def learn(self, values: list) -> tuple[float, float]:
        raise NotImplementedError

    def fit(self, df: DataFrame):
        stats = [(c, k, s) for c in self.columns for k, s in enumerate(self.statistics(present(c)))]
        row = df.agg(*[s.alias(f"{c}__{k}") for c, k, s in stats]).first()
        for c in self.columns:
            shift, scale = self.learn([row[f"{c}__{k}"] for cc, k, _ in stats if cc == c])
            self.shift[c], self.scale[c] = float(shift or 0.0), float(scale or 1.0)
        return self

    def expressions(self, columns):
        return {c: (present(c) - self.shift[c]) / self.scale[c] for c in self.columns}

    def inverse_expressions(self, columns):
        return {c: present(c) * self.scale[c] + self.shift[c] for c in self.columns}


@dataclass
class MinMaxScaler(_Affine):
    """Each column onto [low, high]; ``partial_fit`` widens the ranges by a batch."""

    low: float = 0.0
    high: float = 1.0
    ranges: dict = field(default_factory=dict, init=False)

    def partial_fit(self, df: DataFrame):
        row = df.agg(*[f(present(c)).alias(f"{c}__{f.__name__}") for c in self.columns for f in (F.min, F.max)]).first()
        for c in self.columns:
            if (lo := row[f"{c}__min"]) is not None:
                before = self.ranges.get(c, (lo, lo))
                self.ranges[c] = min(lo, before[0]), max(row[f"{c}__max"], before[1])
            shift, scale = self.learn(self.ranges.get(c, (None, None)))
            self.shift[c], self.scale[c] = float(shift), float(scale)
        return self

    def statistics(self, x):
        return [F.min(x), F.max(x)]

    def learn(self, values):
        lo, hi = values
        if lo is None:
            return 0.0, 1.0
        scale = ((hi - lo) or 1.0) / (self.high - self.low)
        return lo - self.low * scale, scale


@dataclass
class StandardScaler(_Affine):
    """Mean and population deviation; a constant column is only shifted. ``partial_fit``
    merges counts, means and squared deviations of batches."""

    with_mean: bool = True
    with_std: bool = True
    moments: dict = field(default_factory=dict, init=False)

    def statistics(self, x):
        return [F.count(x), F.avg(x), F.var_pop(x)]

    def learn(self, values):
        n, mean, var = values
        return (mean if self.with_mean else 0.0), (np.sqrt(var) if self.with_std and var else 1.0)

    def partial_fit(self, df: DataFrame):
        row = df.agg(*[s.alias(f"{c}__{k}") for c in self.columns for k, s in enumerate(self.statistics(present(c)))]).first()
        for c in self.columns:
            n, mean, var = (row[f"{c}__{k}"] or 0.0 for k in range(3))
            n0, mean0, m0 = self.moments.get(c, (0, 0.0, 0.0))
            total = n + n0
            if total:
                gap = mean - mean0
                self.moments[c] = (total, mean0 + gap * n / total, m0 + var * n + gap * gap * n * n0 / total)
                _, m, sq = self.moments[c]
                self.shift[c], self.scale[c] = self.learn([total, m, sq / total])
        return self


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their means, over their population deviations."""
    return StandardScaler(columns).fit_transform(df)


def mean_and_deviation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, var, std) with population variances, from one aggregate."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(c).alias("x")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.stddev_pop("x").alias("std"))


@dataclass
class MaxAbsScaler(_Affine):
    """Each column over its largest magnitude; ``partial_fit`` raises that by a batch."""

    largest: dict = field(default_factory=dict, init=False)

    def statistics(self, x):
        return [F.max(F.abs(x))]

    def learn(self, values):
        return 0.0, values[0]

    def partial_fit(self, df: DataFrame):
        row = df.agg(*[F.max(F.abs(present(c))).alias(c) for c in self.columns]).first()
        for c in self.columns:
            self.largest[c] = max(row[c] or 0.0, self.largest.get(c, 0.0))
            self.shift[c], self.scale[c] = 0.0, self.largest[c] or 1.0
        return self


@dataclass
class RobustScaler(_Affine):
    """Median and quantile range; quantiles are values of the column (no interpolation)."""

    low: float = 0.25
    high: float = 0.75

    center: bool = True
    with_scale: bool = True

    def fit(self, df: DataFrame):
        for c, (lo, mid, hi) in quantiles(df, self.columns, [self.low, 0.5, self.high]).items():
            self.shift[c] = float(mid or 0.0) if self.center else 0.0
            self.scale[c] = (float((hi or 0.0) - (lo or 0.0)) or 1.0) if self.with_scale else 1.0
        return self


@dataclass
class Normalizer(Operator):
    """Each row over its l1, l2 or max norm; a zero row stays."""

    columns: list[str]
    norm: str = "l2"

    def expressions(self, columns):
        x = [F.abs(present(c)) for c in self.columns]
        total = sum(x[1:], x[0])
        size = {"l1": total, "l2": F.sqrt(sum([a * a for a in x[1:]], x[0] * x[0])), "max": F.greatest(*x) if len(x) > 1 else x[0]}[self.norm]
        return {c: present(c) / F.when(size > 0, size).otherwise(1.0) for c in self.columns}


@dataclass
class ColumnNormalizer(_Affine):
    """Each column over its l1, l2 or max norm; a zero column stays."""

    norm: str = "l2"

    def statistics(self, x):
        return [{"l1": F.sum(F.abs(x)), "l2": F.sqrt(F.sum(x * x)), "max": F.max(F.abs(x))}[self.norm]]

    def learn(self, values):
        return 0.0, values[0]


@dataclass
class KernelCenterer(Operator):
    """Centres a kernel matrix in long form, a row for each (i, j, k). Fitted column means stay a
    table that is joined by j; rows of new points are centred by their own means."""

    i: str = "i"
    j: str = "j"
    k: str = "k"
    means: DataFrame | None = field(default=None, init=False)
    total: float = field(default=0.0, init=False)

    def fit(self, df: DataFrame):
        self.means = df.groupBy(self.j).agg(F.avg(present(self.k)).alias("__mean"))
        self.total = float(df.agg(F.avg(present(self.k))).first()[0] or 0.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.groupBy(self.i).agg(F.avg(present(self.k)).alias("__row"))
        joined = df.join(self.means, self.j).join(rows, self.i)
        return joined.withColumn(self.k, present(self.k) - F.col("__mean") - F.col("__row") + self.total).select(*df.columns)


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """The rows in an order that the seed and the ids decide; restored by ordering by id."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)


@dataclass
class Binarizer(Operator):
    columns: list[str]
    threshold: float = 0.0

    def expressions(self, columns):
        return {c: F.when(present(c) > self.threshold, 1.0).otherwise(0.0) for c in self.columns}


@dataclass
class FunctionTransformer(Operator):
    """``function`` and ``inverse`` map a column expression to another."""

    columns: list[str]
    function: object
    inverse: object = None

    def expressions(self, columns):
        return {c: self.function(F.col(c)) for c in self.columns}

    def inverse_expressions(self, columns):
        return {c: self.inverse(F.col(c)) for c in self.columns}


@dataclass
class DummyFeature(Operator):
    name: str = "ones"

    def expressions(self, columns):
        return {self.name: F.lit(1.0)}


@dataclass
class Imputer(Operator):
    """Missing values become the mean, the median (a value of the column) or the smallest
    of the most frequent values."""

    columns: list[str]
    strategy: str = "mean"
    fill: dict[str, float] = field(default_factory=dict, init=False)

    def fit(self, df):
        if self.strategy == "mean":
            self.fill = df.agg(*[F.avg(present(c)).alias(c) for c in self.columns]).first().asDict()
        elif self.strategy == "median":
            self.fill = {c: q[0] for c, q in quantiles(df, self.columns, [0.5]).items()}
        elif self.strategy == "most_frequent":
            self.fill = most_frequent(df, self.columns)
        else:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        return self

    def inverse_expressions(self, columns):
        return {c: F.col(c) for c in self.columns}

    def expressions(self, columns):
        return {c: F.coalesce(present(c), F.lit(self.fill[c])) for c in self.columns}


@dataclass
class PowerTransformer(Operator):
    """Yeo-Johnson or Box-Cox with the exponent of the largest likelihood: grids of exponents
    are evaluated in one aggregate each, moved outwards while the best is at an end and refined
    around it until they are ``tol`` apart, in at most ``rounds`` aggregates."""

    columns: list[str]
    method: str = "yeo-johnson"
    standardize: bool = False
    rounds: int = 30
    tol: float = 1e-6
    exponent: dict[str, float] = field(default_factory=dict, init=False)
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict, init=False)

    def power(self, x: Column, k: float) -> Column:
        if self.method == "box-cox":
            return F.log(x) if abs(k) < 1e-12 else (F.pow(x, F.lit(k)) - 1) / k
        up = F.log1p(x) if abs(k) < 1e-12 else (F.pow(x + 1, F.lit(k)) - 1) / k
        down = -F.log1p(-x) if abs(k - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - k)) - 1) / (2 - k)
        return F.when(x >= 0, up).otherwise(down)

    def fit(self, df):
        span = {c: (-2.0, 2.0) for c in self.columns}
        for _ in range(self.rounds):
            grid = {c: np.linspace(*span[c], 17) for c in self.columns}
            parts = []
            for c in self.columns:
                x = present(c)
                log = F.log(x) if self.method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
                parts += [(-F.count(x) / 2 * F.log(F.var_pop(self.power(x, float(k)))) + (float(k) - 1) * F.sum(log)).alias(f"{c}__{i}") for i, k in enumerate(grid[c])]
            row = df.agg(*parts).first()
            for c in self.columns:
                score = np.nan_to_num([np.nan if row[f"{c}__{i}"] is None else row[f"{c}__{i}"] for i in range(17)], nan=-np.inf)
                best = int(np.argmax(score))
                self.exponent[c] = float(grid[c][best])
                step = grid[c][1] - grid[c][0]
                reach = (8 if best in (0, 16) and score[best] > score[8] else 1) * step
                span[c] = (grid[c][best] - reach, grid[c][best] + reach)
            if all(hi - lo <= 2 * self.tol for lo, hi in span.values()):
                break
        powers = {c: self.power(present(c), self.exponent[c]) for c in self.columns}
        self.scaling = {c: (0.0, 1.0) for c in self.columns}
        if self.standardize:
            row = df.agg(*[f(powers[c]).alias(f"{c}__{f.__name__}") for c in self.columns for f in (F.avg, F.stddev_pop)]).first()
            self.scaling = {c: (row[f"{c}__avg"] or 0.0, row[f"{c}__stddev_pop"] or 1.0) for c in self.columns}
        return self

    def expressions(self, columns):
        return {c: (self.power(present(c), self.exponent[c]) - self.scaling[c][0]) / self.scaling[c][1] for c in self.columns}

    def inverse_expressions(self, columns):
        out = {}
        for c in self.columns:
            y, k = present(c) * self.scaling[c][1] + self.scaling[c][0], self.exponent[c]
            if self.method == "box-cox":
                out[c] = F.exp(y) if abs(k) < 1e-12 else F.pow(y * k + 1, F.lit(1 / k))
                continue
            up = F.exp(y) - 1 if abs(k) < 1e-12 else F.pow(y * k + 1, F.lit(1 / k)) - 1
            down = 1 - F.exp(-y) if abs(k - 2) < 1e-12 else 1 - F.pow(1 - (2 - k) * y, F.lit(1 / (2 - k)))
            out[c] = F.when(y >= 0, up).otherwise(down)
        return out


@dataclass
class QuantileTransformer(Operator):
    """The interpolated empirical distribution function at ``quantiles`` knots."""

    columns: list[str]
    quantiles: int = 11
    knots: dict[str, list[float]] = field(default_factory=dict, init=False)

    def fit(self, df):
        self.knots = quantiles(df, self.columns, np.linspace(0, 1, self.quantiles).tolist(), interpolate=True)
        return self

    def expressions(self, columns):
        out, n = {}, self.quantiles - 1
        for c in self.columns:
            x, k = present(c), self.knots[c]
            if k[0] is None:
                out[c] = F.lit(None).cast("double")
                continue
            value = F.when(x < k[0], 0.0)
            for i in range(n):
                if k[i + 1] > k[i]:
                    value = value.when(x <= k[i + 1], (i + (x - k[i]) / (k[i + 1] - k[i])) / n)
            value = value.when(x.isNotNull(), 1.0)
            out[c] = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), value))
        return out

    def inverse_expressions(self, columns):
        out, n = {}, self.quantiles - 1
        for c in self.columns:
            y, k = present(c), self.knots[c]
            if k[0] is None:
                out[c] = F.lit(None).cast("double")
                continue
            value = F.when(y <= 0, k[0])
            for i in range(n):
                value = value.when(y <= (i + 1) / n, k[i] + (y * n - i) * (k[i + 1] - k[i]))
            out[c] = value.when(y.isNotNull(), k[n])
        return out


@dataclass
class KBinsDiscretizer(Operator):
    """Bins with uniform or quantile edges; a bin counts the inner edges <= x. ``encode`` is
    ordinal, or onehot-dense for a 0/1 column a bin; the inverse gives the middle of a bin."""

    columns: list[str]
    bins: int = 5
    strategy: str = "quantile"
    encode: str = "ordinal"
    edges: dict[str, list[float]] = field(default_factory=dict, init=False)

    def fit(self, df):
        if self.strategy == "uniform":
            row = df.agg(*[f(present(c)).alias(f"{c}__{n}") for c in self.columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
            self.edges = {c: np.linspace(row[f"{c}__lo"] or 0.0, row[f"{c}__hi"] or 0.0, self.bins + 1).tolist() for c in self.columns}
        elif self.strategy == "quantile":
            found = quantiles(df, self.columns, [k / self.bins for k in range(self.bins + 1)])
            self.edges = {c: [e or 0.0 for e in edges] for c, edges in found.items()}
        else:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        return self

    def expressions(self, columns):
        at = {c: sum([(present(c) >= e).cast("int") for e in self.edges[c][1:-1]], F.lit(0)) for c in self.columns}
        if self.encode == "ordinal":
            return {c: v.cast("double") for c, v in at.items()}
        return {f"{c}_{k}": (v == k).cast("double") for c, v in at.items() for k in range(self.bins)}

    def inverse_expressions(self, columns):
        middle = {c: [(a + b) / 2 for a, b in zip(e, e[1:])] for c, e in self.edges.items()}
        if self.encode == "ordinal":
            return {c: F.try_element_at(F.lit(middle[c]), present(c).cast("int") + 1) for c in self.columns}
        return {c: F.coalesce(*[F.when(F.col(f"{c}_{k}") == 1, m) for k, m in enumerate(middle[c])]) for c in self.columns}


@dataclass
class OneHotEncoder(Operator):
    """A 0/1 column for each sorted distinct value; unseen values give zeros."""

    columns: list[str]
    values: dict[str, list] = field(default_factory=dict, init=False)

    def fit(self, df):
        row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in self.columns]).first()
        self.values = {c: list(row[c]) for c in self.columns}
        return self

    def expressions(self, columns):
        return {f"{c}_{k}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for c in self.columns for k, v in enumerate(self.values[c])}

    def inverse_expressions(self, columns):
        return {c: F.coalesce(*[F.when(F.col(f"{c}_{k}") == 1, F.lit(v)) for k, v in enumerate(self.values[c])]) for c in self.columns}


@dataclass
class LabelBinarizer(OneHotEncoder):
    """One column per class of each label column, ``negative`` or ``positive`` (one more than
    negative if they are equal); the inverse gives the class of the largest column, the first of
    equal ones."""

    negative: float = 0.0
    positive: float = 1.0

    def expressions(self, columns):
        no, yes = float(self.negative), float(self.negative + 1 if self.positive == self.negative else self.positive)
        return {f"{c}_{k}": F.when(F.col(c) == F.lit(v), yes).otherwise(no) for c in self.columns for k, v in enumerate(self.values[c])}

    def inverse_expressions(self, columns):
        out = {}
        for c in self.columns:
            hot = F.array(*[F.col(f"{c}_{k}") for k in range(len(self.values[c]))])
            out[c] = F.element_at(F.lit(self.values[c]), F.array_position(hot, F.array_max(hot)).cast("int"))
        return out


@dataclass
class MultiLabelBinarizer(Operator):
    """A 0/1 column for each class of an array column, classes sorted bytewise."""

    column: str
    classes: list = field(default_factory=list, init=False)

    def fit(self, df):
        rows = df.select(F.explode(self.column).alias("v")).filter("v is not null").distinct().orderBy("v").collect()
        self.classes = [r.v for r in rows]
        return self

    def expressions(self, columns):
        return {f"{self.column}_{k}": F.array_contains(self.column, F.lit(v)).cast("double") for k, v in enumerate(self.classes)}

    def inverse_expressions(self, columns):
        """The classes of a row, sorted."""
        return {self.column: F.array_compact(F.array(*[F.when(F.col(f"{self.column}_{k}") == 1, F.lit(v)) for k, v in enumerate(self.classes)]))}


@dataclass
class PositionBinarizer(Operator):
    """Several label columns that share one sorted dictionary: a block of 0/1 columns for each
    position, a column for each class in it."""

    columns: list[str]
    classes: list = field(default_factory=list, init=False)

    def fit(self, df):
        rows = df.select(F.explode(F.array(*self.columns)).alias("v")).filter("v is not null").distinct().orderBy("v").collect()
        self.classes = [r.v for r in rows]
        return self

    def expressions(self, columns):
        return {f"{c}_{k}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0) for c in self.columns for k, v in enumerate(self.classes)}

    def inverse_expressions(self, columns):
        return {c: F.coalesce(*[F.when(F.col(f"{c}_{k}") == 1, F.lit(v)) for k, v in enumerate(self.classes)]) for c in self.columns}


@dataclass
class LabelEncoder(Operator):
    """Codes by sorted position, with the support of each class; unseen values give null."""

    column: str
    classes: list = field(default_factory=list, init=False)
    support: list[int] = field(default_factory=list, init=False)

    def fit(self, df):
        self.classes, self.support = [], []
        return self.partial_fit(df)

    def partial_fit(self, df):
        """Adds the classes and counts of a batch."""
        counts = dict(zip(self.classes, self.support))
        for value, n in df.filter(F.col(self.column).isNotNull()).groupBy(self.column).count().collect():  # a row for each class
            counts[value] = counts.get(value, 0) + n
        self.classes = sorted(counts)
        self.support = [counts[v] for v in self.classes]
        return self

    def expressions(self, columns):
        at = F.array_position(F.lit(self.classes), F.col(self.column))
        return {self.column: F.when(at > 0, at - 1)}

    def inverse_expressions(self, columns):
        return {self.column: F.try_element_at(F.lit(self.classes), F.col(self.column).cast("int") + 1)}


@dataclass
class PolynomialFeatures(Operator):
    """All products of up to ``degree`` columns, in the order of combinations by degree."""

    columns: list[str]
    degree: int = 2
    interaction_only: bool = False
    include_bias: bool = True

    def terms(self) -> list[tuple[str, ...]]:
        pick = combinations if self.interaction_only else combinations_with_replacement
        return [t for d in range(0 if self.include_bias else 1, self.degree + 1) for t in pick(self.columns, d)]

    def expressions(self, columns):
        out = {}
        for k, term in enumerate(self.terms()):
            x = F.lit(1.0)
            for c in term:
                x = x * present(c)
            out[f"poly_{k}"] = x
        return out

    def inverse_expressions(self, columns):
        return {t[0]: F.col(f"poly_{k}") for k, t in enumerate(self.terms()) if len(t) == 1}


def gram(df: DataFrame, columns: list[str], weight: Column | None = None) -> np.ndarray:
    """X'X of the columns by one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(w * F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


@dataclass
class PCA(Operator):
    """Singular directions of the columns as they are (not centred), from their Gram
    matrix; the largest entry of a direction is positive."""

    columns: list[str]
    components: int | None = None
    min_variance_ratio: float | None = None
    directions: np.ndarray | None = field(default=None, init=False)
    ratio: np.ndarray | None = field(default=None, init=False)
    singular: np.ndarray | None = field(default=None, init=False)

    def fit(self, df):
        values, vectors = np.linalg.eigh(gram(df, self.columns))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(values))])
        self.ratio, self.singular = values / (values.sum() or 1.0), np.sqrt(values)
        k = self.components or len(values)
        if self.min_variance_ratio is not None:
            k = int(np.searchsorted(np.cumsum(self.ratio), self.min_variance_ratio - 1e-12)) + 1
        self.directions = vectors[:, : min(k, len(values))]
        return self

    def expressions(self, columns):
        return {f"pc_{k}": sum([present(c) * float(v) for c, v in zip(self.columns, self.directions[:, k])], F.lit(0.0)) for k in range(self.directions.shape[1])}

    def inverse_expressions(self, columns):
        n = self.directions.shape[1]
        return {c: sum([F.col(f"pc_{k}") * float(self.directions[i, k]) for k in range(n)], F.lit(0.0)) for i, c in enumerate(self.columns)}
