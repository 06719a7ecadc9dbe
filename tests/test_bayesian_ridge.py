from decimal import Decimal, localcontext

import numpy as np
import pytest

from lodestone.operators import linear as L

#: n, a, c, d, p, q, yy as the SQL of bayesian_ridge has them, of 36,000,000 rows of unrelated columns.
SLOW = (36_000_000.0, 7496096400.0, 1039.945198269969, 30653.0064, 2712120640.228665, -676186.6468495659, 3.250289756736e16)
NOTHING = (36_000_000.0, 7496096400.0, -5873.967979182959, 30653.0064, -569191153.8541263, -6554405.8419715045, 3.250289756736e16)


def recursion(n, a, c, d, p, q, yy, number=float):
    """The 300 steps of the SQL."""
    n, a, c, d, p, q, yy = map(number, (n, a, c, d, p, q, yy))
    prior, noise = number(1), n / yy
    for i in range(301):
        det = (noise * a + prior) * (noise * d + prior) - noise * noise * c * c
        w, v = noise * ((noise * d + prior) * p - noise * c * q) / det, noise * ((noise * a + prior) * q - noise * c * p) / det
        if i < 300:
            gamma = 2 - prior * (noise * (a + d) + 2 * prior) / det
            prior, noise = gamma / (w * w + v * v), (n - gamma) / (yy - 2 * (w * p + v * q) + a * w * w + 2 * c * w * v + d * v * v)
    return float(w), float(v)


def fitted(n, a, c, d, p, q, yy):
    return L.BayesianRidge(["x", "z"], "y").fit_moments(L.Moments(n, np.zeros(2), np.array([[a, c], [c, d]]), np.array([p, q]), yy, 0.0)).coef


@pytest.mark.parametrize("g", [SLOW, NOTHING])
def test_steps_of_the_sql_without_rounding(g):
    with localcontext() as c:
        c.prec = 1000
        want = recursion(*g, number=Decimal)
    got = fitted(*g)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-20)
    if g is NOTHING:  # in double precision the SQL's gamma is rounding alone, and its steps begin again
        assert np.abs(want).max() < 1e-12 and np.abs(recursion(*g)).max() > 0.005
    else:
        assert np.allclose(got, recursion(*g), rtol=1e-9)


def test_small_targets():
    n, a, c, d, p, q, yy = 1000.0, 1000.0, 100.0, 2000.0, 900.0, -500.0, 1500.0
    want, s = fitted(n, a, c, d, p, q, yy), 1e-9
    assert np.allclose(fitted(n, a, c, d, p * s, q * s, yy * s * s) / s, want, rtol=1e-6)


def test_constant_target_and_exact_fit():
    assert np.all(fitted(10.0, 5.0, 0.0, 5.0, 0.0, 0.0, 0.0) == 0)
    assert np.allclose(fitted(10.0, 5.0, 0.0, 5.0, 10.0, -5.0, 25.0), [2, -1])
