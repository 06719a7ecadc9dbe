"""Piecewise interpolation: knots become literals of a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pieces(x: Column, knots: np.ndarray, piece) -> Column:
    """``piece(k)`` on the k-th segment; the end segments reach outwards."""
    out = None
    for k in range(len(knots) - 2):
        out = F.when(x < float(knots[k + 1]), piece(k)) if out is None else out.when(x < float(knots[k + 1]), piece(k))
    last = piece(len(knots) - 2)
    return last if out is None else out.otherwise(last)


def linear(x: Column, xs, ys) -> Column:
    """Linear interpolation through the knots whose y isn't NaN; equal x take their mean."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    keep = ~np.isnan(ys)
    knots = np.unique(xs[keep])
    values = np.array([ys[keep][xs[keep] == k].mean() for k in knots])
    if len(knots) == 1:
        return F.lit(float(values[0]))
    slope = np.diff(values) / np.diff(knots)
    return _pieces(x, knots, lambda k: float(values[k]) + (x - float(knots[k])) * float(slope[k]))


def bilinear(x: Column, y: Column, xs, ys, z) -> Column:
    """z[i][j] at (xs[i], ys[j]): along y at the bracketing xs, then between them."""
    xs = np.asarray(xs, float)
    rows = [linear(y, ys, row) for row in z]
    return _pieces(x, xs, lambda k: rows[k] + (x - float(xs[k])) * (rows[k + 1] - rows[k]) / float(xs[k + 1] - xs[k]))


def cubic_spline(x: Column, xs, ys) -> Column:
    """The natural cubic spline through the knots."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    n, h = len(xs), np.diff(xs)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)

    def piece(k: int) -> Column:
        t = x - float(xs[k])
        slope = (ys[k + 1] - ys[k]) / h[k] - h[k] * (2 * m[k] + m[k + 1]) / 6
        return float(ys[k]) + t * (float(slope) + t * (float(m[k] / 2) + t * float((m[k + 1] - m[k]) / (6 * h[k]))))

    return _pieces(x, xs, piece)
