"""Linear models and naive Bayes from distributed sufficient statistics.

Fits read the data once (closed forms, coordinate descent on the Gram matrix) or once a
step (Newton); the driver solves systems of the number of columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .metrics import ClassScore, RegressionScore
from .optimizers import minimize


@dataclass
class Moments:
    """n, means and centred cross products of columns and a target."""

    n: float
    mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    y_mean: float


def cross_products(df: DataFrame, columns: list[str], centered: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """n, the means (zeros unless ``centered``) and the products of the gaps from them, from one
    aggregate. Centred ones are Spark's merged covariances, which keep their digits where means
    are large. Rows with a missing value are left out."""
    d = len(columns)
    work = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    product = F.covar_pop if centered else lambda x, y: F.avg(F.col(x) * F.col(y))
    row = work.agg(F.count("*").alias("n"), *[F.avg(f"c{k}").alias(f"m{k}") for k in range(d)], *[product(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((d, d))
    for i, j in pairs:
        out[i, j] = out[j, i] = (row[f"s{i}_{j}"] or 0.0) * row.n
    return float(row.n), np.array([(row[f"m{k}"] or 0.0) if centered else 0.0 for k in range(d)]), out


def moments(df: DataFrame, columns: list[str], target: str, fit_intercept: bool = True) -> Moments:
    d = len(columns)
    n, mean, c = cross_products(df, [*columns, target], fit_intercept)
    return Moments(n, mean[:d], c[:d, :d], c[:d, d], c[d, d], float(mean[d]))


@dataclass
class LinearRegression(RegressionScore):
    """Least squares; ``alpha`` and ``l1_ratio`` add the elastic-net penalty
    (alpha * (l1_ratio * |w| + (1 - l1_ratio) * w'w)) / 2n, or with ``per_row``
    alpha * (l1_ratio * |w| + (1 - l1_ratio) * w'w / 2)."""

    columns: list[str]
    target: str
    alpha: float = 0.0
    l1_ratio: float = 0.0
    positive: bool = False
    fit_intercept: bool = True
    normalize: bool = False
    per_row: bool = False
    tol: float = 1e-10
    max_iter: int = 10_000
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: float = field(default=0.0, init=False)

    def solve(self, m: Moments) -> np.ndarray:
        scale = np.sqrt(np.maximum(np.diag(m.xx), 1e-300)) if self.normalize else np.ones(len(m.xy))
        a, b = m.xx / np.outer(scale, scale), m.xy / scale
        if self.l1_ratio == 0 and not self.positive:
            return np.linalg.lstsq(a + self.alpha * np.eye(len(b)), b, rcond=None)[0] / scale
        rows = m.n if self.per_row else 1
        l1, l2, w = self.alpha * self.l1_ratio * (rows if self.per_row else 0.5), self.alpha * (1 - self.l1_ratio) * rows, np.zeros(len(b))
        for _ in range(self.max_iter):
            old = w.copy()
            for j in range(len(b)):
                rho = b[j] - a[j] @ w + a[j, j] * w[j]
                step = np.sign(rho) * max(abs(rho) - l1, 0) / (a[j, j] + l2 or 1.0)
                w[j] = max(step, 0) if self.positive else step
            if np.abs(w - old).max(initial=0) <= self.tol * max(1.0, np.abs(w).max(initial=0)):
                break
        return w / scale

    def fit(self, df: DataFrame) -> LinearRegression:
        return self.fit_moments(moments(df, self.columns, self.target, self.fit_intercept))

    def fit_moments(self, m: Moments) -> LinearRegression:
        self.coef = self.solve(m)
        self.intercept = m.y_mean - float(m.mean @ self.coef)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, dot([F.col(c).cast("double") for c in self.columns], [float(w) for w in self.coef]) + self.intercept)


def ridge(columns, target, alpha=1.0, **kw):
    return LinearRegression(columns, target, alpha, 0.0, **kw)


def elastic_net(columns, target, alpha=1.0, l1_ratio=0.5, **kw):
    return LinearRegression(columns, target, alpha, l1_ratio, per_row=True, **kw)


def lasso(columns, target, alpha=1.0, **kw):
    return elastic_net(columns, target, alpha, 1.0, **kw)


def alpha_grid(m: Moments, l1_ratio: float = 1.0, n: int = 100, eps: float = 1e-3) -> list[float]:
    """Descending alphas from the smallest that leaves every coefficient at zero."""
    top = float(np.abs(m.xy).max(initial=0)) / max(m.n * l1_ratio, 1e-300)
    return [float(a) for a in np.geomspace(max(top, 1e-300), max(top * eps, 1e-300), n)]


def enet_path(df: DataFrame, columns: list[str], target: str, alphas: list[float] | None = None, l1_ratio: float = 0.5, fit_intercept: bool = False, positive: bool = False) -> list[tuple[float, np.ndarray]]:
    """Coefficients for each alpha from one scan; the columns aren't centred."""
    m = moments(df, columns, target, fit_intercept)
    chosen = alpha_grid(m, l1_ratio) if alphas is None else alphas
    return [(a, elastic_net(columns, target, a, l1_ratio, positive=positive).fit_moments(m).coef) for a in chosen]


def lasso_path(df: DataFrame, columns: list[str], target: str, alphas: list[float] | None = None, **kw) -> list[tuple[float, np.ndarray]]:
    return enet_path(df, columns, target, alphas, 1.0, **kw)


@dataclass
class MultiTaskElasticNet(RegressionScore):
    """Several targets that share which columns count: 1/2n |Y - XW|^2 + alpha * (l1_ratio *
    sum of the norms of W's rows + (1 - l1_ratio) / 2 * |W|^2), by descent over rows of W on the
    Gram matrix of one scan. coef has a row for each target."""

    columns: list[str]
    targets: list[str]
    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    tol: float = 1e-10
    max_iter: int = 10_000
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: np.ndarray | None = field(default=None, init=False)

    def fit(self, df: DataFrame) -> MultiTaskElasticNet:
        d = len(self.columns)
        n, mean, c = cross_products(df, [*self.columns, *self.targets], self.fit_intercept)
        a, b, w = c[:d, :d], c[:d, d:], np.zeros((d, len(self.targets)))
        l1, l2 = self.alpha * self.l1_ratio * n, self.alpha * (1 - self.l1_ratio) * n
        for _ in range(self.max_iter):
            old = w.copy()
            for j in range(d):
                rho = b[j] - a[j] @ w + a[j, j] * w[j]
                norm = float(np.sqrt(rho @ rho))
                w[j] = rho * max(1 - l1 / norm, 0) / (a[j, j] + l2) if norm and a[j, j] + l2 else 0.0
            if np.abs(w - old).max(initial=0) <= self.tol * max(1.0, np.abs(w).max(initial=0)):
                break
        self.coef, self.intercept = w.T, mean[d:] - mean[:d] @ w
        return self

    @property
    def target(self) -> list[str]:
        return self.targets

    def predict(self, df: DataFrame, prefix: str = "prediction") -> DataFrame:
        x = [F.col(c).cast("double") for c in self.columns]
        return df.withColumns({f"{prefix}_{k}": dot(x, [float(v) for v in w]) + float(i) for k, (w, i) in enumerate(zip(self.coef, self.intercept))})


@dataclass
class MultiOutputRegression(RegressionScore):
    """Least squares, with an L2 penalty alpha / 2n, of several targets from one set of cross
    products. coef has a row for each target. Rows that lack a target are left out for all."""

    columns: list[str]
    targets: list[str]
    alpha: float = 0.0
    fit_intercept: bool = True
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: np.ndarray | None = field(default=None, init=False)

    def fit(self, df: DataFrame) -> MultiOutputRegression:
        d = len(self.columns)
        _, mean, c = cross_products(df, [*self.columns, *self.targets], self.fit_intercept)
        w = np.linalg.lstsq(c[:d, :d] + self.alpha * np.eye(d), c[:d, d:], rcond=None)[0]
        self.coef, self.intercept = w.T, mean[d:] - mean[:d] @ w
        return self

    target = MultiTaskElasticNet.target
    predict = MultiTaskElasticNet.predict


def multi_task_lasso(columns, targets, alpha=1.0, **kw):
    return MultiTaskElasticNet(columns, targets, alpha, 1.0, **kw)


@dataclass
class GradientRegression(RegressionScore):
    """Least squares with the penalty of LinearRegression by any method of optimizers.minimize.
    One scan gives the Gram matrix, from which every step takes its loss and gradient; columns
    are scaled to unit variance while it runs."""

    columns: list[str]
    target: str
    alpha: float = 0.0
    l1_ratio: float = 0.0
    method: str = "lbfgs"
    iterations: int = 1000
    options: dict = field(default_factory=dict)
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: float = field(default=0.0, init=False)

    def fit(self, df: DataFrame) -> GradientRegression:
        m = moments(df, self.columns, self.target)
        n = max(m.n, 1)
        s, unit = np.sqrt(np.maximum(np.diag(m.xx) / n, 1e-300)), np.sqrt(max(m.yy / n, 1e-300))
        a, b = m.xx / np.outer(s, s) / n, m.xy / s / unit / n

        def loss(w):
            c = w * unit / s  # the coefficients of the columns as they are
            penalty = self.alpha * (self.l1_ratio * np.abs(c).sum() + (1 - self.l1_ratio) * c @ c) / (2 * n * unit**2)
            slope = self.alpha * (self.l1_ratio * np.sign(c) + 2 * (1 - self.l1_ratio) * c) / (2 * n * unit * s)
            return 0.5 * w @ a @ w - b @ w + penalty, a @ w - b + slope

        w, _ = minimize(loss, np.zeros(len(b)), self.method, self.iterations, 1e-10, **self.options)
        self.coef = w * unit / s
        self.intercept = m.y_mean - float(m.mean @ self.coef)
        return self

    predict = LinearRegression.predict


@dataclass
class BayesianRidge(RegressionScore):
    """Evidence maximisation over the eigenvectors of the Gram matrix; predict adds the
    standard deviation of the predictive distribution. Where the evidence prefers coefficients of
    zero the prior grows without end, and they are as good as zero."""

    columns: list[str]
    target: str
    iterations: int = 300
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: float = field(default=0.0, init=False)

    def fit(self, df: DataFrame) -> BayesianRidge:
        return self.fit_moments(moments(df, self.columns, self.target))

    def fit_moments(self, m: Moments) -> BayesianRidge:
        if not m.n:
            raise ValueError("there are no rows to fit")
        values, v = np.linalg.eigh(m.xx)
        values, b = np.maximum(values, 0), v.T @ m.xy
        least = max(np.finfo(float).eps * m.yy, 1e-200)  # what rounding leaves of a perfect fit
        noise, prior = m.n / max(m.yy, least), 1.0
        for _ in range(self.iterations):
            w = noise * b / (noise * values + prior)
            gamma = (noise * values / (noise * values + prior)).sum()
            rss = max(m.yy - 2 * w @ b + (values * w * w).sum(), least)
            if w @ w < 1e-200:
                break
            new = gamma / (w @ w), (m.n - gamma) / rss
            done = abs(new[0] - prior) <= 1e-13 * prior and abs(new[1] - noise) <= 1e-13 * noise
            prior, noise = new
            if done:
                break
        self.coef = v @ (noise * b / (noise * values + prior))
        self.sigma = (v / (noise * values + prior)) @ v.T
        self.mean, self.noise, self.prior = m.mean, noise, prior
        self.intercept = m.y_mean - float(m.mean @ self.coef)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        x = [F.col(c).cast("double") for c in self.columns]
        z = [a - float(k) for a, k in zip(x, self.mean)]
        var = sum([dot(z, [float(s) for s in row]) * zi for row, zi in zip(self.sigma, z)], F.lit(1 / self.noise))
        return df.withColumns({name: dot(x, [float(w) for w in self.coef]) + self.intercept, f"{name}_std": F.sqrt(var)})


@dataclass
class LogisticRegression(ClassScore):
    """Binary logistic regression, penalty alpha / 2n |w|^2, by Newton steps: one aggregate
    gives gradient and Hessian. No step changes a coefficient by more than ``longest``;
    ``converged`` tells whether the steps came to an end, which they don't where the classes
    can be separated and alpha is 0. Without rows all coefficients are 0."""

    columns: list[str]
    target: str
    alpha: float = 0.0
    iterations: int = 25
    tol: float = 1e-10
    longest: float = 8.0
    coef: np.ndarray | None = field(default=None, init=False)
    intercept: float = field(default=0.0, init=False)
    converged: bool = field(default=False, init=False)

    def fit(self, df: DataFrame) -> LogisticRegression:
        d = len(self.columns) + 1
        work = df.select(F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{k + 1}") for k, c in enumerate(self.columns)], F.col(self.target).cast("double").alias("y"))
        x = [F.col(f"x{k}") for k in range(d)]
        theta, ridge_ = np.zeros(d), np.r_[0.0, np.full(d - 1, self.alpha)]
        for _ in range(self.iterations):
            z = dot(x, [float(t) for t in theta])
            p = 1 / (1 + F.exp(-z))
            terms = [F.sum((p - F.col("y")) * x[i]).alias(f"g{i}") for i in range(d)]
            terms += [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
            row = work.agg(*terms).first()
            if row["g0"] is None:
                break
            g = np.array([row[f"g{i}"] for i in range(d)]) + ridge_ * theta
            h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + np.diag(ridge_ + 1e-12)
            step = np.linalg.solve(h, g)
            theta = theta - step * min(1.0, self.longest / max(np.abs(step).max(), 1e-300))
            self.converged = bool(np.abs(step).max() <= self.tol * max(1.0, np.abs(theta).max()))
            if self.converged:
                break
        self.intercept, self.coef = float(theta[0]), theta[1:]
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        z = dot([F.col(c).cast("double") for c in self.columns], [float(w) for w in self.coef]) + self.intercept
        return df.withColumns({f"{name}_proba": 1 / (1 + F.exp(-z)), name: (z > 0).cast("double")})


@dataclass
class GaussianNB(ClassScore):
    """Class means and population variances, smoothed by a share of the largest variance.
    ``weight`` names a column of weights; classes without any weight are left out."""

    columns: list[str]
    target: str
    smoothing: float = 1e-9
    priors: list[float] | None = None
    weight: str | None = None
    table: list = field(default_factory=list, init=False)
    seen: dict = field(default_factory=dict, init=False)

    def statistics(self, df: DataFrame) -> DataFrame:
        by = df.groupBy(F.col(self.target).alias("label"))
        if self.weight is None:
            stats = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in self.columns for n, f in (("mean", F.avg), ("var", F.var_pop))]
            return by.agg(F.count("*").alias("n"), *stats)
        # gaps from the overall means keep the digits of the variances
        centre = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in self.columns]).first()
        w, stats = F.col(self.weight).cast("double"), []
        for c in self.columns:
            gap, at = F.col(c).cast("double") - F.lit(centre[c]), F.lit(centre[c])
            total = F.sum(F.when(gap.isNotNull(), w))
            mean = F.try_divide(F.sum(w * gap), total)
            stats += [(mean + at).alias(f"mean_{c}"), F.greatest(F.try_divide(F.sum(w * gap * gap), total) - mean * mean, F.lit(0.0)).alias(f"var_{c}")]
        return by.agg(F.sum(w).alias("n"), *stats).filter("n > 0")

    def fit(self, df: DataFrame) -> GaussianNB:
        self.seen = {}
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame) -> GaussianNB:
        """Merges the counts, means and squared gaps of each class of a batch."""
        for r in self.statistics(df).collect():
            mean, var = (np.array([r[f"{s}_{c}"] or 0.0 for c in self.columns]) for s in ("mean", "var"))
            n, mean0, sq = self.seen.get(r.label, (0, np.zeros(len(mean)), np.zeros(len(mean))))
            total, gap = n + r.n, mean - mean0
            self.seen[r.label] = total, mean0 + gap * r.n / total, sq + var * r.n + gap * gap * n * r.n / total
        total = sum(n for n, _, _ in self.seen.values())
        if not total:
            raise ValueError("there are no rows to fit")
        centre = sum(n * mean for n, mean, _ in self.seen.values()) / total
        spread = sum(sq + n * (mean - centre) ** 2 for n, mean, sq in self.seen.values()) / total
        extra = self.smoothing * float(spread.max())
        self.table = [
            (label, self.priors[k] if self.priors else n / total, [(m, v / n + extra or 1e-300) for m, v in zip(mean, sq)])
            for k, (label, (n, mean, sq)) in enumerate(sorted(self.seen.items()))
        ]
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        joint = [
            sum([-0.5 * float(np.log(2 * np.pi * v)) - (F.col(c).cast("double") - float(m)) ** 2 / (2 * float(v)) for c, (m, v) in zip(self.columns, stats)], F.lit(float(np.log(prior))))
            for _, prior, stats in self.table
        ]
        j = F.array(*joint)
        labels = F.lit([label for label, _, _ in self.table])
        return df.withColumns({f"{name}_log_joint": j, name: F.element_at(labels, F.array_position(j, F.array_max(j)).cast("int"))})

    def predict_proba(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``predict`` with the logarithms of the probabilities of the classes, and these."""
        j = F.col(f"{name}_log_joint")
        top = F.array_max(j)
        out = self.predict(df, name).withColumn(f"{name}_log_proba", F.transform(j, lambda v: v - top - F.log(F.aggregate(j, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))
        return out.withColumn(f"{name}_proba", F.transform(f"{name}_log_proba", F.exp))
