"""Minimisers for parameters that fit on the driver.

The function to minimise returns (value, gradient) and usually sums both over a table with
one aggregate, so each step costs one pass of the cluster."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class FirstOrder:
    """Base of the step rules. The plain step shrinks as step_size * 100 / (100 + t);
    ``clip`` bounds the norm of each column of the gradient."""

    step_size: float = 1e-4
    momentum: float = 0.0
    clip: float = 0.0
    eps: float = 1e-8
    t: int = field(default=0, init=False)
    state: dict = field(default_factory=dict, init=False)

    def slot(self, name: str, like: np.ndarray) -> np.ndarray:
        return self.state.setdefault(name, np.zeros_like(like))

    def clipped(self, grad: np.ndarray) -> np.ndarray:
        if not self.clip:
            return grad
        norm = np.sqrt((grad * grad).sum(0))
        return grad * np.where(norm > self.clip, self.clip / np.maximum(norm, 1e-300), 1.0)

    def update(self, grad: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        move = self.update(self.clipped(np.asarray(grad, float)))
        if self.momentum:
            move = move + self.momentum * self.slot("last", move)
            self.state["last"] = move
        return theta + move


@dataclass
class SGD(FirstOrder):
    momentum: float = 0.9

    def update(self, grad):
        return -self.step_size * 100 / (100 + self.t) * grad


@dataclass
class Adagrad(FirstOrder):
    step_size: float = 0.5

    def update(self, grad):
        total = self.state["sum"] = self.slot("sum", grad) + grad * grad
        return -self.step_size * grad / np.sqrt(total + self.eps)


@dataclass
class RMSProp(FirstOrder):
    step_size: float = 0.05
    decay: float = 0.9

    def update(self, grad):
        mean = self.state["mean"] = self.decay * self.slot("mean", grad) + (1 - self.decay) * grad * grad
        return -self.step_size * grad / (np.sqrt(mean) + self.eps)


@dataclass
class Adadelta(FirstOrder):
    decay: float = 0.9
    eps: float = 1e-4

    def update(self, grad):
        mean = self.state["mean"] = self.decay * self.slot("mean", grad) + (1 - self.decay) * grad * grad
        moved = self.slot("moved", grad)
        move = -np.sqrt(moved + self.eps) / np.sqrt(mean + self.eps) * grad
        self.state["moved"] = self.decay * moved + (1 - self.decay) * move * move
        return move


@dataclass
class Adam(FirstOrder):
    step_size: float = 0.5
    beta1: float = 0.9
    beta2: float = 0.999

    def update(self, grad):
        m = self.state["m"] = self.beta1 * self.slot("m", grad) + (1 - self.beta1) * grad
        v = self.state["v"] = self.beta2 * self.slot("v", grad) + (1 - self.beta2) * grad * grad
        return -self.step_size * (m / (1 - self.beta1**self.t)) / (np.sqrt(v / (1 - self.beta2**self.t)) + self.eps)


SOLVERS: dict[str, type[FirstOrder]] = {"sgd": SGD, "adagrad": Adagrad, "rmsprop": RMSProp, "adadelta": Adadelta, "adam": Adam}


def solver(name: str, **options) -> FirstOrder:
    if name not in SOLVERS:
        raise ValueError(f"unknown solver {name!r}, known: {sorted(SOLVERS)}")
    return SOLVERS[name](**options)


def _line_search(f: Objective, x, value, grad, direction, first: float = 1.0):
    """A step that meets the weak Wolfe conditions, by bisection."""
    slope, low, high, t = float(grad @ direction), 0.0, np.inf, first
    for _ in range(50):
        new_value, new_grad = f(x + t * direction)
        if not np.isfinite(new_value) or new_value > value + 1e-4 * t * slope:
            high = t
        elif float(new_grad @ direction) < 0.9 * slope:
            low = t
        else:
            break
        t = 2 * low if np.isinf(high) else (low + high) / 2
    return t, new_value, new_grad


def _quasi_newton(f: Objective, x, iterations, tol, direction_of, remember):
    value, grad = f(x)
    for k in range(iterations):
        if np.abs(grad).max(initial=0) <= tol:
            break
        d = direction_of(grad)
        if grad @ d >= 0:
            d = -grad
        first = 1.0 if k else min(1.0, 1 / max(np.abs(grad).sum(), 1e-300))
        t, new_value, new_grad = _line_search(f, x, value, grad, d, first)
        if not np.isfinite(new_value) or new_value > value:
            break
        remember(t * d, new_grad - grad)
        x, value, grad, last = x + t * d, new_value, new_grad, value
        if abs(last - value) <= 1e-15 * max(1.0, abs(value)):
            break
    return x, value


def lbfgs(f: Objective, x: np.ndarray, iterations: int = 200, tol: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, float]:
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def direction(grad):
        q, back = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def remember(s, y):
        if s @ y > 1e-12 * (y @ y):
            pairs.append((s, y))
            del pairs[:-memory]

    return _quasi_newton(f, np.asarray(x, float), iterations, tol, direction, remember)


def bfgs(f: Objective, x: np.ndarray, iterations: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    return lbfgs(f, x, iterations, tol, memory=max(iterations, 1))


def gradient_descent(f: Objective, x: np.ndarray, iterations: int = 1000, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    return _quasi_newton(f, np.asarray(x, float), iterations, tol, lambda g: -g, lambda s, y: None)


def conjugate_gradient(f: Objective, x: np.ndarray, iterations: int = 500, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Hestenes-Stiefel directions, restarted where they stop descending."""
    last: dict = {}

    def direction(grad):
        d = -grad
        if last and last["d"] @ last["y"]:
            d = d + max((grad @ last["y"]) / (last["d"] @ last["y"]), 0.0) * last["d"]
        return d

    def remember(s, y):
        last.update(d=s, y=y)

    return _quasi_newton(f, np.asarray(x, float), iterations, tol, direction, remember)


def nelder_mead(f: Objective, x: np.ndarray, iterations: int = 2000, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Simplex search; the gradient isn't used."""
    x = np.asarray(x, float)
    points = [x] + [x + (0.05 * x[k] or 0.00025) * np.eye(len(x))[k] for k in range(len(x))]
    simplex = sorted(((f(p)[0], k, p) for k, p in enumerate(points)), key=lambda t: t[:2])
    n = len(points)
    for turn in range(iterations):
        best, worst = simplex[0], simplex[-1]
        if abs(worst[0] - best[0]) <= tol and max(np.abs(p - best[2]).max() for _, _, p in simplex) <= tol:
            break
        centre = np.mean([p for _, _, p in simplex[:-1]], axis=0)

        def at(scale):
            p = centre + scale * (centre - worst[2])
            return f(p)[0], n + turn, p

        new = at(1.0)
        if new[0] < best[0]:
            new = min(new, at(2.0), key=lambda t: t[0])
        elif new[0] >= simplex[-2][0]:
            new = at(0.5 if new[0] < worst[0] else -0.5)
        if new[0] < worst[0]:
            simplex[-1] = new
        else:
            simplex = [best] + [(f(q := best[2] + (p - best[2]) / 2)[0], k, q) for _, k, p in simplex[1:]]
        simplex.sort(key=lambda t: t[:2])
    return simplex[0][2], simplex[0][0]


METHODS = {"lbfgs": lbfgs, "bfgs": bfgs, "cg": conjugate_gradient, "gradientdescent": gradient_descent, "neldermead": nelder_mead}


def minimize(f: Objective, x: np.ndarray, method: str = "lbfgs", iterations: int = 500, tol: float = 1e-6, **options) -> tuple[np.ndarray, float]:
    """(x, value) by a method of METHODS or a step rule of SOLVERS, which keeps its best point."""
    if method in METHODS:
        return METHODS[method](f, x, iterations, tol, **options)
    rule, x, best = solver(method, **options), np.asarray(x, float), (np.inf, None)
    for _ in range(iterations):
        value, grad = f(x)
        if value < best[0]:
            best = (value, x)
        if np.abs(grad).max(initial=0) <= tol:
            break
        x = rule.step(x, grad)
    return (x, np.inf) if best[1] is None else (best[1], best[0])
