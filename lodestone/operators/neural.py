"""Multilayer perceptrons.

Solver lbfgs sums the loss and its gradient over the whole table once a step. Solvers sgd and
adam run mini-batches within each partition from the same weights and average the weights by
rows after each epoch; with one partition that is the usual sequential training. Either way
only sums of the size of the network leave a task, added up in two rounds. Rows with a null or
NaN in a feature or the target teach nothing and are predicted as null."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ClassScore, RegressionScore
from .optimizers import lbfgs

ACTIVATIONS = {
    "identity": (lambda z: z, lambda y: np.ones_like(y)),
    "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda y: y * (1 - y)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
    "relu": (lambda z: np.maximum(z, 0), lambda y: (y > 0).astype(float)),
}
MAX_CLASSES = 10_000


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Layers:
    """Shapes of a network whose weights and biases lie in one vector, layer by layer."""

    units: list[int]
    activation: str = "relu"
    output: str = "identity"

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.units, self.units[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng, factor = np.random.default_rng(seed), 2.0 if self.activation == "logistic" else 6.0
        return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) * np.sqrt(factor / (a + b)) for a, b in zip(self.units, self.units[1:])])

    def split(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) of each layer, as views."""
        out, at = [], 0
        for a, b in zip(self.units, self.units[1:]):
            out.append((theta[at + b : at + b + a * b].reshape(a, b), theta[at : at + b]))
            at += (a + 1) * b
        return out

    def penalized(self, theta: np.ndarray) -> np.ndarray:
        """theta with its biases set to zero."""
        out = theta.copy()
        for _, bias in self.split(out):
            bias[:] = 0
        return out

    def forward(self, theta: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        outs, layers = [x], self.split(theta)
        for k, (w, bias) in enumerate(layers):
            z = outs[-1] @ w + bias
            last = k == len(layers) - 1
            outs.append(softmax(z) if last and self.output == "softmax" else ACTIVATIONS[self.output if last else self.activation][0](z))
        return outs

    def loss(self, got: np.ndarray, y: np.ndarray) -> float:
        if self.output == "identity":
            return float(((got - y) ** 2).sum() / 2)
        p = np.clip(got, 1e-15, 1 - 1e-15)
        if self.output == "softmax":
            return float(-(y * np.log(p)).sum())
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the rows of the loss and of its gradient, without the penalty."""
        outs, grad = self.forward(theta, x), np.empty_like(theta)
        delta, slots = outs[-1] - y, self.split(grad)
        for k in range(len(slots) - 1, -1, -1):
            w, bias = slots[k]
            w[:], bias[:] = outs[k].T @ delta, delta.sum(0)
            if k:
                delta = (delta @ self.split(theta)[k][0].T) * ACTIVATIONS[self.activation][1](outs[k])
        return self.loss(outs[-1], y), grad


@dataclass
class Steps:
    """State of the mini-batch rules: theta and two vectors of moments."""

    solver: str = "adam"
    rate: float = 1e-3
    momentum: float = 0.9
    nesterov: bool = True
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def step(self, state: np.ndarray, grad: np.ndarray, t: int) -> None:
        theta, m, v = state
        if self.solver == "adam":
            m += (1 - self.beta1) * (grad - m)
            v += (1 - self.beta2) * (grad * grad - v)
            theta -= self.rate * (m / (1 - self.beta1**t)) / (np.sqrt(v / (1 - self.beta2**t)) + self.eps)
            return
        m *= self.momentum
        m -= self.rate * grad
        theta += self.momentum * m - self.rate * grad if self.nesterov else m


def tree_sum(parts: DataFrame, width: int, count: int, fan: int = 16) -> np.ndarray:
    """Sum of the vectors (as bytes) of column ``v``; over ``fan`` of them are added up in that
    many tasks first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            for v in pdf["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    rows = (parts.repartition(fan).mapInPandas(add, "v binary") if count > fan else parts).collect()
    return np.sum([np.frombuffer(r.v) for r in rows], axis=0) if rows else np.zeros(width)


@dataclass
class MLP:
    """Common part of classifier and regressor. Loss: mean data loss + alpha / 2n |W|^2, biases
    not penalised. ``learning_rate`` is constant, invscaling or adaptive (sgd). With
    ``early_stopping`` about ``validation`` of the rows, chosen by hash, decide when to end."""

    columns: list[str]
    target: str
    hidden: tuple[int, ...] = (100,)
    activation: str = "relu"
    solver: str = "adam"
    alpha: float = 1e-4
    batch_size: int = 200
    learning_rate: str = "constant"
    rate: float = 1e-3
    power_t: float = 0.5
    max_iter: int = 200
    momentum: float = 0.9
    nesterov: bool = True
    shuffle: bool = True
    early_stopping: bool = False
    validation: float = 0.1
    patience: int = 10
    tol: float = 1e-4
    seed: int = 0
    layers: Layers | None = field(default=None, init=False)
    theta: np.ndarray | None = field(default=None, init=False)
    losses: list[float] = field(default_factory=list, init=False)
    classes: list | None = field(default=None, init=False)

    def __post_init__(self):
        known = {"activation": ACTIVATIONS, "solver": ("sgd", "adam", "lbfgs"), "learning_rate": ("constant", "invscaling", "adaptive")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {sorted(values)}")
        if min(self.hidden, default=1) < 1 or self.alpha < 0 or self.rate <= 0 or not 0 <= self.momentum <= 1 or not 0 <= self.validation < 1:
            raise ValueError("hidden, alpha, rate, momentum or validation is out of range")

    # what classifier and regressor differ in
    def outputs(self, df: DataFrame) -> tuple[int, str]:
        raise NotImplementedError

    def encode(self, values: pd.Series) -> np.ndarray:
        raise NotImplementedError

    def _present(self):
        return ~F.lit(False) if not self.columns else F.forall(F.array(*[F.col(c).cast("double") for c in self.columns]), lambda v: v.isNotNull() & ~F.isnan(v))

    def _work(self, df: DataFrame) -> DataFrame:
        y = F.col(self.target) if isinstance(self.target, str) else F.array(*[F.col(t).cast("double") for t in self.target])
        known = y.isNotNull() if isinstance(self.target, str) else F.forall(y, lambda v: v.isNotNull())
        return df.filter(self._present() & known).select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.columns)], y.alias("y"))

    def _begin(self, work: DataFrame) -> None:
        if self.theta is None:
            n, output = self.outputs(work)
            self.layers = Layers([len(self.columns), *self.hidden, n], self.activation, output)
            self.theta = self.layers.start(self.seed)
            self._state, self._t, self._rate = np.zeros((2, self.layers.size)), 0, self.rate
        self._tasks = work.rdd.getNumPartitions()

    def _arrays(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf.iloc[:, :-1].to_numpy(float), self.encode(pdf["y"])

    def _full(self, work: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, float]:
        layers, arrays, sent = self.layers, self._arrays, work.sparkSession.sparkContext.broadcast(theta)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(layers.size + 2)
            for pdf in batches:
                x, y = arrays(pdf)
                loss, grad = layers.gradient(sent.value, x, y)
                total += np.r_[loss, len(x), grad]
            yield pd.DataFrame({"v": [total.tobytes()]})

        got = tree_sum(work.mapInPandas(sums, "v binary"), layers.size + 2, self._tasks)
        sent.unpersist()
        n, w = max(got[1], 1.0), layers.penalized(theta)
        return (got[0] + self.alpha / 2 * (w @ w)) / n, (got[2:] + self.alpha * w) / n, got[1]

    def _epoch(self, work: DataFrame, epoch: int) -> float:
        layers, arrays, rule = self.layers, self._arrays, Steps(self.solver, self._rate, self.momentum, self.nesterov)
        size, alpha, shuffle, seed, t0 = max(1, self.batch_size), self.alpha, self.shuffle, self.seed, self._t
        sent = work.sparkSession.sparkContext.broadcast(np.vstack([self.theta, self._state]))

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, t, n, loss = sent.value.copy(), t0, 0, 0.0
            rng = np.random.default_rng([seed, epoch])
            for pdf in batches:
                x, y = arrays(pdf)
                order = rng.permutation(len(x)) if shuffle else np.arange(len(x))
                for at in range(0, len(x), size):
                    rows = order[at : at + size]
                    got, grad = layers.gradient(state[0], x[rows], y[rows])
                    w, t = layers.penalized(state[0]), t + 1
                    loss += got + alpha / 2 * (w @ w)
                    rule.step(state, (grad + alpha * w) / len(rows), t)
                n += len(x)
            yield pd.DataFrame({"v": [np.r_[loss, n, t * n, state.ravel() * n].tobytes()]})

        got = tree_sum(work.mapInPandas(train, "v binary"), 3 * layers.size + 3, self._tasks)
        sent.unpersist()
        if got[1]:
            state = (got[3:] / got[1]).reshape(3, -1)
            self.theta, self._state, self._t = state[0], state[1:], round(got[2] / got[1])
        return got[0] / max(got[1], 1.0)

    def partial_fit(self, df: DataFrame) -> MLP:
        """One epoch over ``df`` from the weights at hand (sgd and adam)."""
        work = self._work(df)
        self._begin(work)
        self.losses.append(self._epoch(work, len(self.losses)))
        return self

    def fit(self, df: DataFrame) -> MLP:
        self.theta, self.losses, work = None, [], self._work(df)
        self._begin(work)
        if self.solver == "lbfgs":
            self.theta, value = lbfgs(lambda t: self._full(work, t)[:2], self.theta, self.max_iter, self.tol / 100)
            self.losses.append(value)
            return self
        held = F.pmod(F.xxhash64(*work.columns), F.lit(1000)) < int(1000 * self.validation)
        test, work = (work.filter(held), work.filter(~held)) if self.early_stopping else (None, work)
        best, stale = (np.inf, self.theta), 0
        for epoch in range(self.max_iter):
            loss = self._epoch(work, epoch)
            self.losses.append(loss)
            if self.learning_rate == "invscaling":
                self._rate = self.rate / (epoch + 1) ** self.power_t
            judged = self._full(test, self.theta)[0] if test is not None else loss
            stale = stale + 1 if judged > best[0] - self.tol else 0
            best = min(best, (judged, self.theta), key=lambda b: b[0])
            if stale >= self.patience:
                if self.learning_rate != "adaptive" or self._rate <= 1e-6:
                    break
                self._rate, stale = self._rate / 5, 0
        if test is not None:
            self.theta = best[1]
        return self

    def outputs_column(self):
        """Array of the network's outputs for each row."""
        layers, theta = self.layers, self.theta

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(layers.forward(theta, np.array(x.tolist(), float))[-1]), index=x.index) if len(x) else x

        zeros = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])
        return F.when(self._present(), run(zeros))

    def dump(self) -> str:
        """The model as JSON: params, coefs_ and intercepts_."""
        parts = self.layers.split(self.theta)
        params = {"activation": self.activation, "solver": self.solver, "alpha": self.alpha, "hidden_layer_sizes": list(self.hidden), "out_activation": self.layers.output, "classes": self.classes}
        return json.dumps({"params": params, "coefs_": [w.tolist() for w, _ in parts], "intercepts_": [b.tolist() for _, b in parts]})

    def load(self, text: str) -> MLP:
        """Weights of ``dump``."""
        doc = json.loads(text)
        coefs, biases = [np.array(w, float) for w in doc["coefs_"]], [np.array(b, float) for b in doc["intercepts_"]]
        params = doc.get("params", {})
        self.activation = params.get("activation", self.activation)
        self.classes = params.get("classes", self.classes)
        output = params.get("out_activation") or self.default_output(len(biases[-1]))
        self.layers = Layers([coefs[0].shape[0], *[len(b) for b in biases]], self.activation, output)
        self.hidden = tuple(self.layers.units[1:-1])
        self.theta = np.concatenate([np.r_[b, w.ravel()] for w, b in zip(coefs, biases)])
        self._state, self._t, self._rate = np.zeros((2, self.layers.size)), 0, self.rate
        return self


@dataclass
class MLPClassifier(ClassScore, MLP):
    """Logistic output for two classes, softmax for more."""

    def default_output(self, n: int) -> str:
        return "logistic" if n == 1 else "softmax"

    def outputs(self, work):
        self.classes = sorted(r.y for r in work.select("y").distinct().limit(MAX_CLASSES + 1).collect())
        if not 1 <= len(self.classes) <= MAX_CLASSES:
            raise ValueError(f"the target has no class or over {MAX_CLASSES}")
        n = 1 if len(self.classes) <= 2 else len(self.classes)
        return n, self.default_output(n)

    def encode(self, values):
        if len(self.classes) <= 2:
            return (values == self.classes[-1]).to_numpy(float)[:, None]
        return (values.to_numpy()[:, None] == np.array(self.classes, dtype=values.dtype)[None, :]).astype(float)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the probabilities of the classes, and the likeliest class."""
        out = df.withColumn(f"{name}_proba", self.outputs_column())
        p = F.col(f"{name}_proba")
        if self.layers.output == "logistic":
            out = out.withColumn(f"{name}_proba", F.when(p.isNotNull(), F.array(1 - p[0], p[0])))
        best = F.array_position(p, F.array_max(p)).cast("int")
        labels = self.classes if len(self.classes) > 1 else [self.classes[0]] * 2
        return out.withColumn(name, F.when(p.isNotNull(), F.element_at(F.lit(labels), best)))


@dataclass
class MLPRegressor(RegressionScore, MLP):
    """Identity output, squared loss. ``target`` may be a list of columns; predictions are then
    prediction_0, prediction_1 and so on, and rows that lack a target are left out."""

    def default_output(self, n: int) -> str:
        return "identity"

    def outputs(self, work):
        return 1 if isinstance(self.target, str) else len(self.target), "identity"

    def encode(self, values):
        if isinstance(self.target, str):
            return values.to_numpy(float)[:, None]
        return np.array(values.tolist(), float).reshape(len(values), len(self.target))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if isinstance(self.target, str):
            return df.withColumn(name, self.outputs_column()[0])
        out = df.withColumn("__outputs", self.outputs_column())
        return out.withColumns({f"{name}_{k}": F.col("__outputs")[k] for k in range(len(self.target))}).drop("__outputs")


def multinomial_logistic(columns: list[str], target: str, alpha: float = 0.0, max_iter: int = 200) -> MLPClassifier:
    """Logistic regression over any number of classes: a network without hidden layers."""
    return MLPClassifier(columns, target, hidden=(), solver="lbfgs", alpha=alpha, max_iter=max_iter)
