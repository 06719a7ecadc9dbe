"""Gaussian processes: kernels with log parameters and their gradients, and regression.

The exact posterior needs a Cholesky factor of the training rows, so at most ``max_rows`` are
fitted (more raise an error); prediction runs over tables of any size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import RegressionScore
from .optimizers import lbfgs

FIXED = None
WIDE = (1e-5, 1e5)


class Kernel:
    """``theta`` are the logs of the parameters that have bounds; the others are fixed."""

    stationary = True

    def parameters(self) -> list[tuple[float, tuple | None]]:
        return []

    def rebuilt(self, values: list[float]) -> Kernel:
        return self

    def matrix(self, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        raise NotImplementedError

    def gradients(self, a: np.ndarray) -> list[np.ndarray]:
        """Derivatives of matrix(a) by the log of each parameter, fixed ones included."""
        raise NotImplementedError

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        return np.diag(self.matrix(a))

    @staticmethod
    def _free(bounds) -> bool:
        return bounds is not FIXED and bounds[0] != bounds[1]

    @property
    def theta(self) -> np.ndarray:
        return np.log([v for v, b in self.parameters() if self._free(b)])

    @property
    def bounds(self) -> np.ndarray:
        return np.log([b for _, b in self.parameters() if self._free(b)]).reshape(-1, 2)

    def with_theta(self, theta) -> Kernel:
        new = iter(np.exp(np.asarray(theta, float)))
        return self.rebuilt([float(next(new)) if self._free(b) else v for v, b in self.parameters()])

    def free_gradients(self, a: np.ndarray) -> list[np.ndarray]:
        return [g for g, (_, b) in zip(self.gradients(a), self.parameters()) if self._free(b)]

    def __add__(self, other):
        return Sum(self, other if isinstance(other, Kernel) else Constant(other))

    def __mul__(self, other):
        return Product(self, other if isinstance(other, Kernel) else Constant(other))

    def __pow__(self, exponent: float):
        return Power(self, exponent)


def _gaps(a, b):
    return a[:, None, :] - (a if b is None else b)[None, :, :]


@dataclass
class Constant(Kernel):
    value: float = 1.0
    limits: tuple | None = WIDE

    def parameters(self):
        return [(self.value, self.limits)]

    def rebuilt(self, values):
        return Constant(values[0], self.limits)

    def matrix(self, a, b=None):
        return np.full((len(a), len(a if b is None else b)), self.value)

    def gradients(self, a):
        return [self.matrix(a)]


@dataclass
class White(Kernel):
    """Noise where two rows are equal within 1e-8."""

    level: float = 1.0
    limits: tuple | None = WIDE

    def parameters(self):
        return [(self.level, self.limits)]

    def rebuilt(self, values):
        return White(values[0], self.limits)

    def matrix(self, a, b=None):
        return self.level * (np.abs(_gaps(a, b)).max(2) <= 1e-8)

    def gradients(self, a):
        return [self.matrix(a)]


@dataclass
class RBF(Kernel):
    """exp(-|x - y|^2 / 2 l^2); ``scale`` is a number or one for each feature."""

    scale: float | tuple = 1.0
    limits: tuple | None = WIDE

    def _scales(self) -> list[float]:
        return [float(s) for s in np.atleast_1d(self.scale)]

    def parameters(self):
        return [(s, self.limits) for s in self._scales()]

    def rebuilt(self, values):
        return RBF(values[0] if len(values) == 1 else tuple(values), self.limits)

    def matrix(self, a, b=None):
        return np.exp(-0.5 * ((_gaps(a, b) / np.array(self._scales())) ** 2).sum(2))

    def gradients(self, a):
        parts, k = (_gaps(a, None) / np.array(self._scales())) ** 2, self.matrix(a)
        if len(self._scales()) == 1:
            return [k * parts.sum(2)]
        return [k * parts[:, :, j] for j in range(parts.shape[2])]

    def diagonal(self, a):
        return np.ones(len(a))


@dataclass
class DotProduct(Kernel):
    """sigma^2 + x.y"""

    sigma: float = 1.0
    limits: tuple | None = WIDE
    stationary = False

    def parameters(self):
        return [(self.sigma, self.limits)]

    def rebuilt(self, values):
        return DotProduct(values[0], self.limits)

    def matrix(self, a, b=None):
        return self.sigma**2 + a @ (a if b is None else b).T

    def gradients(self, a):
        return [np.full((len(a), len(a)), 2 * self.sigma**2)]


@dataclass
class _Pair(Kernel):
    left: Kernel
    right: Kernel

    @property
    def stationary(self):
        return self.left.stationary and self.right.stationary

    def parameters(self):
        return self.left.parameters() + self.right.parameters()

    def rebuilt(self, values):
        n = len(self.left.parameters())
        return type(self)(self.left.rebuilt(values[:n]), self.right.rebuilt(values[n:]))


class Sum(_Pair):
    def matrix(self, a, b=None):
        return self.left.matrix(a, b) + self.right.matrix(a, b)

    def gradients(self, a):
        return self.left.gradients(a) + self.right.gradients(a)


class Product(_Pair):
    def matrix(self, a, b=None):
        return self.left.matrix(a, b) * self.right.matrix(a, b)

    def gradients(self, a):
        x, y = self.left.matrix(a), self.right.matrix(a)
        return [g * y for g in self.left.gradients(a)] + [g * x for g in self.right.gradients(a)]


@dataclass
class Power(Kernel):
    base: Kernel
    exponent: float

    @property
    def stationary(self):
        return self.base.stationary

    def parameters(self):
        return self.base.parameters()

    def rebuilt(self, values):
        return Power(self.base.rebuilt(values), self.exponent)

    def matrix(self, a, b=None):
        return self.base.matrix(a, b) ** self.exponent

    def gradients(self, a):
        outer = self.exponent * self.base.matrix(a) ** (self.exponent - 1)
        return [outer * g for g in self.base.gradients(a)]


@dataclass
class GaussianProcess(RegressionScore):
    """Regression; ``noise`` is added to the diagonal, one number or one for each fitted row in
    the order of ``order_col``. predict gives mean and standard deviation, those of the prior
    where nothing was fitted, null where a feature is missing."""

    columns: list[str]
    target: str
    order_col: str
    kernel: Kernel = field(default_factory=lambda: Product(Constant(1.0), RBF(1.0)))
    noise: object = 1e-10
    optimize: bool = True
    normalize: bool = False
    max_rows: int = 4000
    x: np.ndarray | None = field(default=None, init=False)

    def fit(self, df: DataFrame) -> GaussianProcess:
        rows = df.select(self.order_col, *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.columns)], F.col(self.target).cast("double").alias("y")).dropna()
        pdf = rows.limit(self.max_rows + 1).toPandas()
        if len(pdf) > self.max_rows:
            raise ValueError(f"over max_rows={self.max_rows} rows to fit; choose rows first")
        pdf = pdf.sort_values(self.order_col, kind="stable")
        return self.fit_arrays(pdf[[f"x{k}" for k in range(len(self.columns))]].to_numpy(float), pdf["y"].to_numpy(float))

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean = x, float(y.mean()) if self.normalize and len(y) else 0.0
        self.y = y - self.mean
        if self.optimize and len(self.kernel.theta) and len(x):
            low, high = self.kernel.bounds.T

            def loss(theta):
                inside = np.clip(theta, low, high)
                value, grad = self.log_marginal_likelihood(inside)
                return -value + ((theta - inside) ** 2).sum(), -grad * (theta == inside) + 2 * (theta - inside)

            theta, _ = lbfgs(loss, self.kernel.theta, 100)
            self.kernel = self.kernel.with_theta(np.clip(theta, low, high))
        self.factor = np.linalg.cholesky(self.kernel.matrix(x) + np.diag(np.broadcast_to(self.noise, len(x)))) if len(x) else np.zeros((0, 0))
        self.dual = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, self.y)) if len(x) else np.zeros(0)
        return self

    def log_marginal_likelihood(self, theta=None) -> tuple[float, np.ndarray]:
        """Value and gradient by theta; minus infinity where the matrix isn't positive definite."""
        kernel = self.kernel if theta is None else self.kernel.with_theta(theta)
        k = kernel.matrix(self.x) + np.diag(np.broadcast_to(self.noise, len(self.x)))
        try:
            factor = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return -np.inf, np.zeros(len(kernel.theta))
        dual = np.linalg.solve(factor.T, np.linalg.solve(factor, self.y))
        value = -0.5 * self.y @ dual - np.log(np.diag(factor)).sum() - 0.5 * len(self.y) * np.log(2 * np.pi)
        inner = np.outer(dual, dual) - np.linalg.inv(k)
        return float(value), np.array([0.5 * (inner * g).sum() for g in kernel.free_gradients(self.x)])

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariance of a few points."""
        prior = self.kernel.matrix(x)
        if self.x is None or not len(self.x):
            return np.zeros(len(x)), prior
        cross = self.kernel.matrix(x, self.x)
        v = np.linalg.solve(self.factor, cross.T)
        return cross @ self.dual + self.mean, prior - v.T @ v

    def predict(self, df: DataFrame, name: str = "prediction", block: int = 512) -> DataFrame:
        posterior = self.posterior

        @F.pandas_udf("mean double, std double")
        def run(x: pd.Series) -> pd.DataFrame:
            got = []
            for at in range(0, len(x), block):  # bounds the matrices of a batch
                mean, cov = posterior(np.array(x.iloc[at : at + block].tolist(), float))
                got.append(np.c_[mean, np.sqrt(np.maximum(np.diag(cov), 0))])
            return pd.DataFrame(np.vstack(got) if got else np.zeros((0, 2)), columns=["mean", "std"])

        x = [F.col(c).cast("double") for c in self.columns]
        whole = F.forall(F.array(*x), lambda v: v.isNotNull() & ~F.isnan(v))
        out = df.withColumn(name, F.when(whole, run(F.array(*[F.coalesce(c, F.lit(0.0)) for c in x]))))
        return out.withColumns({f"{name}_std": F.col(f"{name}.std"), name: F.col(f"{name}.mean")})
