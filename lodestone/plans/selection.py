"""Folds, cross-validation, grid search and pipelines."""

from __future__ import annotations

import copy
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import LinearRegression, Moments, moments
from ..operators.ranks import numbered, running, seeded_hash


def k_fold(df: DataFrame, id_col: str, k: int = 3, seed: int = 0) -> DataFrame:
    """``df`` with a column fold: rows of unique ids in a seeded order, dealt into folds of n // k
    rows, the first n % k of them with one more."""
    return numbered(df, id_col, seed).withColumn("fold", F.pmod("__rank", F.lit(k)).cast("int")).drop("__rank", "__total")


def ordered_fold(df: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """``df`` with a column fold: rows of unique numeric ids in their order, cut into k runs of
    n // k rows, the first n % k of them with one more."""
    ranks = running(df.select(id_col).withColumn("__one", F.lit(1)), id_col, ["__one"])
    rank, n = F.col("run___one") - 1, F.col("all___one")
    size, more = F.floor(n / k), n % k
    fold = F.when(rank < more * (size + 1), F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return df.join(ranks.select(id_col, fold.cast("int").alias("fold")), id_col)


def group_fold(df: DataFrame, id_col: str, k: int = 3, seed: int = 0) -> DataFrame:
    """``df`` with a column fold that the id alone decides, so that rows of one id stay together
    and nothing is shuffled; folds are about equally large."""
    return df.withColumn("fold", F.pmod(seeded_hash(id_col, seed), F.lit(k)).cast("int"))


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of unique ids in a seeded order: the first ceil(n * test_size) are the test, or
    ceil(min(n, test_size)) if that is over 1."""
    rows = numbered(df, id_col, seed)
    size = F.ceil(F.col("__total") * F.lit(float(test_size))) if test_size <= 1 else F.least(F.col("__total"), F.lit(math.ceil(test_size)))
    return rows.filter(F.col("__rank") >= size).drop("__rank", "__total"), rows.filter(F.col("__rank") < size).drop("__rank", "__total")


@dataclass
class Fold:
    """What a fold of a cross-validation gave."""

    number: int
    score: float
    model: object
    fit_seconds: float
    score_seconds: float


def cross_validation(model, df: DataFrame, id_col: str, k: int = 3, seed: int = 0, score=None, jobs: int = 2, ordered: bool = False) -> list[Fold]:
    """Each fold judged by a copy of the model fitted to the others: ``score`` of the predictions,
    or the model's own score. ``jobs`` folds run at a time. ``ordered`` gives the best first."""
    folds = group_fold(df, id_col, k, seed)

    def run(f: int) -> Fold:
        began = time.perf_counter()
        fitted = copy.deepcopy(model).fit(folds.filter(F.col("fold") != f))
        between = time.perf_counter()
        test = folds.filter(F.col("fold") == f)
        got = float(score(fitted.predict(test)) if score else fitted.score(test))
        return Fold(f, got, fitted, between - began, time.perf_counter() - between)

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        found = list(pool.map(run, range(k)))
    return sorted(found, key=lambda f: -f.score) if ordered else found


def cross_validate(model, df: DataFrame, id_col: str, k: int = 3, seed: int = 0, score=None, jobs: int = 2) -> list[float]:
    """The scores of ``cross_validation``, fold by fold."""
    return [f.score for f in cross_validation(model, df, id_col, k, seed, score, jobs)]


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def set_params(model, params: dict):
    """A copy of the model with other parameters; ``step__name`` sets one of a pipeline's step."""
    out = copy.deepcopy(model)
    for name, value in params.items():
        at, last = out, name
        if "__" in name:
            step, last = name.split("__", 1)
            at = dict(out.steps).get(step)
        if at is None or not hasattr(at, last):
            raise ValueError(f"no parameter {name}")
        setattr(at, last, value)
    return out


@dataclass
class GridSearch:
    """Tries all parameters of a grid by cross-validation and fits the best to all rows.
    ``lower_is_better`` is for scores that are errors; ties go to the first."""

    model: object
    id_col: str
    grid: dict[str, list]
    k: int = 3
    seed: int = 0
    judge: object = None
    lower_is_better: bool = False
    refit: bool = True
    results: list[tuple[dict, float]] = field(default_factory=list, init=False)
    best_params: dict | None = field(default=None, init=False)
    best_score: float | None = field(default=None, init=False)
    best_model: object = field(default=None, init=False)

    def fit(self, df: DataFrame) -> GridSearch:
        self.results = []
        for params in parameter_grid(self.grid):
            scores = cross_validate(set_params(self.model, params), df, self.id_col, self.k, self.seed, self.judge)
            self.results.append((params, sum(scores) / len(scores)))
        self.best_params, self.best_score = (min if self.lower_is_better else max)(self.results, key=lambda r: r[1])
        self.best_model = set_params(self.model, self.best_params).fit(df) if self.refit else None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.best_model.predict(df)

    def score(self, df: DataFrame) -> float:
        return float(self.judge(self.predict(df)) if self.judge else self.best_model.score(df))


def grid_search(model, df: DataFrame, id_col: str, grid: dict[str, list], k: int = 3, seed: int = 0, score=None) -> tuple[dict, list[tuple[dict, float]]]:
    """The parameters with the best mean fold score, and all of them with theirs."""
    search = GridSearch(model, id_col, grid, k, seed, score, refit=False).fit(df)
    return search.best_params, search.results


def merge(parts: list[Moments]) -> Moments:
    """The moments of several sets of rows together."""
    out = parts[0]
    for m in parts[1:]:
        n, gap, gap_y = out.n + m.n, m.mean - out.mean, m.y_mean - out.y_mean
        f = out.n * m.n / n
        out = Moments(n, out.mean + gap * m.n / n, out.xx + m.xx + f * np.outer(gap, gap), out.xy + m.xy + f * gap * gap_y, out.yy + m.yy + f * gap_y * gap_y, out.y_mean + gap_y * m.n / n)
    return out


def fold_coefficients(model: LinearRegression, df: DataFrame, id_col: str, k: int = 3, seed: int = 0) -> list:
    """Fits of a linear model to all folds but one, from one pass a fold: the moments of
    the training rows are those of the other folds together."""
    folds = group_fold(df, id_col, k, seed)
    parts = [moments(folds.filter(F.col("fold") == f), model.columns, model.target) for f in range(k)]
    return [copy.deepcopy(model).fit_moments(merge(parts[:f] + parts[f + 1 :])) for f in range(k)]


class Pipeline:
    """Named steps: transformers, then perhaps a model with fit and predict. ``target`` is a
    transformer of one column, the model's target: the model learns its transformed values, and
    predictions are turned back."""

    def __init__(self, *steps: tuple[str, object], target=None):
        self.steps, self.scaled = steps, target

    def fit(self, df: DataFrame) -> Pipeline:
        if self.scaled is not None:
            df = self.scaled.fit_transform(df)
        for _, step in self.steps:
            step.fit(df)
            if hasattr(step, "transform"):
                df = step.transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            if hasattr(step, "transform"):
                df = step.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for _, step in reversed(self.steps):
            if hasattr(step, "inverse_transform"):
                df = step.inverse_transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.steps[-1][1].predict(self.transform(df))
        if self.scaled is None:
            return out
        (column,) = self.scaled.columns
        back = self.scaled.inverse_expressions([column])[column]
        kept = [c for c in out.columns if c not in (column, "prediction")]
        held = out.select(*kept, *([F.col(column).alias("__target")] if column in out.columns else []), F.col("prediction").alias(column))
        done = held.withColumn("prediction", back).drop(column)
        return done.withColumnRenamed("__target", column).select(*out.columns)

    @property
    def target(self):
        return self.steps[-1][1].target

    def score(self, df: DataFrame) -> float:
        """The score of the last step's kind, of predictions in the units of ``df``."""
        return type(self.steps[-1][1]).score(self, df)

    def clone(self) -> Pipeline:
        return copy.deepcopy(self)


def make_pipeline(*steps, target=None) -> Pipeline:
    return Pipeline(*[(type(s).__name__.lower(), s) for s in steps], target=target)
