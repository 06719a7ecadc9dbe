"""Column expressions: activations, distances, kernels and vector helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVATIONS = {
    "identity": lambda x: x,
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
}


def dot(a: list[Column], b: list) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b, strict=True)], F.lit(0.0))


def minkowski(a: list[Column], b: list, p: float = 2.0) -> Column:
    """Minkowski distance of order ``p``; p may be infinite."""
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    if p == float("inf"):
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    if p == 1:
        return reduce(lambda s, t: s + t, gaps)
    if p == 2:
        return F.sqrt(reduce(lambda s, t: s + t, [g * g for g in gaps]))
    return F.pow(reduce(lambda s, t: s + t, [F.pow(g, F.lit(float(p))) for g in gaps]), F.lit(1.0 / p))


def kernel(name: str, a: list[Column], b: list, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Column:
    """Kernels linear, poly, rbf and sigmoid between two points."""
    if name == "rbf":
        return F.exp(-gamma * reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))
    d = dot(a, b)
    return {"linear": d, "poly": F.pow(gamma * d + coef0, F.lit(float(degree))), "sigmoid": F.tanh(gamma * d + coef0)}[name]
