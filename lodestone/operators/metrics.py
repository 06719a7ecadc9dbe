"""Classification, ranking and regression metrics as aggregates and windows.

Each function takes a DataFrame and column names; ``weight`` is an optional column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranged, running


def _w(weight: str | None):
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


class RegressionScore:
    """Adds ``score`` to models with ``target`` and ``predict``."""

    def score(self, df: DataFrame, weight: str | None = None) -> float:
        """r2 of the predictions for ``df``; the mean over the targets where there are several."""
        targets = [self.target] if isinstance(self.target, str) else list(self.target)
        names = ["prediction"] if isinstance(self.target, str) else [f"prediction_{k}" for k in range(len(targets))]
        return float(multioutput_scores(self.predict(df), list(zip(targets, names)), "uniform", weight).first().r2)


class ClassScore:
    """Adds ``score`` to classifiers with ``target`` and ``predict``."""

    def score(self, df: DataFrame, weight: str | None = None) -> float:
        """The share of the rows of ``df`` whose class is predicted."""
        return float(accuracy(self.predict(df), self.target, "prediction", weight).first().accuracy)


def accuracy(df: DataFrame, true: str, predicted: str, weight: str | None = None, normalize: bool = True) -> DataFrame:
    right = F.sum(F.when(F.col(true) == F.col(predicted), _w(weight)).otherwise(0.0))
    return df.agg((right / F.sum(_w(weight)) if normalize else right).alias("accuracy"))


def confusion_matrix(df: DataFrame, true: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(true, predicted, n) in long form; absent pairs are zeros."""
    return df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.sum(_w(weight)).alias("n"))


def precision_recall_f(df: DataFrame, true: str, predicted: str, beta: float = 1.0, weight: str | None = None) -> DataFrame:
    """(label, precision, recall, fscore, support) of each true label; 0 where a denominator
    is 0. Two conditional sums over the confusion matrix, which labels bound."""
    cells = confusion_matrix(df, true, predicted, weight)
    sides = cells.select("n", F.explode(F.array(F.struct(F.col("true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("true") == F.col("predicted")).alias("hit"))
    sums = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0.0)).alias("tp"),
        F.sum(F.col("n") * F.col("s.t")).alias("support"),
        F.sum(F.col("n") * F.col("s.p")).alias("guessed"),
    )
    p, r, b = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0), beta * beta
    out = sums.filter("support > 0").select("label", p.alias("precision"), r.alias("recall"), "support", "tp", "guessed")
    f = (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall"))
    return out.withColumn("fscore", F.when(F.col("precision") + F.col("recall") > 0, f).otherwise(0.0))


def averaged(scores: DataFrame, average: str = "macro") -> DataFrame:
    """macro, weighted (by support) or micro (pooled) means of precision_recall_f."""
    if average == "micro":
        p, r = F.sum("tp") / F.sum("guessed"), F.sum("tp") / F.sum("support")
        return scores.agg(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("fscore"))
    if average == "weighted":
        return scores.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "fscore")])
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "fscore")])


def binary_curve(df: DataFrame, true: str, score: str, positive=1, weight: str | None = None) -> DataFrame:
    """(threshold, tps, fps): cumulative counts at each distinct score, from the highest. Rows
    without a score are left out."""
    return _curve(df, true, score, positive, weight).select("threshold", "tps", "fps")


def _curve(df: DataFrame, true: str, score: str, positive, weight: str | None) -> DataFrame:
    """binary_curve with the row's own counts tp and fp and the sums of all, pos and neg. Rows are
    summed by score first and then counted up range by range, so that no task sees all scores and
    nothing has to look at the row before."""
    hit = F.col(true) == positive
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(hit, _w(weight)).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, 0.0).otherwise(_w(weight))).alias("fp")
    )
    names = {"run_tp": "tps", "run_fp": "fps", "all_tp": "pos", "all_fp": "neg"}
    return running(by, "threshold", ["tp", "fp"], descending=True).withColumnsRenamed(names)


def roc_curve(df: DataFrame, true: str, score: str, positive=1, weight: str | None = None, origin: bool = False) -> DataFrame:
    """(threshold, fpr, tpr); rates are null without negatives or positives. With ``origin`` the
    point (0, 0) comes first, at the highest score plus 1, if that score has a negative."""
    curve = _curve(df, true, score, positive, weight)
    if origin:
        top = curve.agg(F.max_by(F.struct("threshold", "fp"), "threshold").alias("t")).filter("t.fp > 0")
        zero = top.select((F.col("t.threshold") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        return _rates(curve).union(zero)
    return _rates(curve)


def _rates(curve: DataFrame) -> DataFrame:
    return curve.select("threshold", F.try_divide("fps", "neg").alias("fpr"), F.try_divide("tps", "pos").alias("tpr"))


def auc(curve: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Trapezoids from (0, 0) along ascending x. Ranges of x are added up by themselves; the first
    row of a range starts from the last point of the range before."""
    dealt = ranged(curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x")
    ends = dealt.groupBy("__range").agg(F.max(F.struct("x", "y")).alias("end"))  # a row for each range
    last = ends.select("__range", F.lag("end").over(Window.partitionBy(F.lit(1)).orderBy("__range")).alias("end"))
    w = Window.partitionBy("__range").orderBy("x", "y")
    x0, y0 = (F.coalesce(F.lag(c).over(w), F.col(f"end.{c}"), F.lit(0.0)) for c in "xy")
    return dealt.join(F.broadcast(last), "__range").select(((F.col("x") - x0) * (F.col("y") + y0) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def roc_auc(df: DataFrame, true: str, score: str, positive=1, weight: str | None = None) -> DataFrame:
    a = F.col("fp") * (2 * F.col("tps") - F.col("tp")) / 2
    return _curve(df, true, score, positive, weight).agg(F.try_divide(F.sum(a), F.max("pos") * F.max("neg")).alias("auc"))


def precision_recall_curve(df: DataFrame, true: str, score: str, positive=1, weight: str | None = None, end: bool = False) -> DataFrame:
    """(threshold, precision, recall) down to the first threshold of full recall; with ``end`` and
    the point (1, 0), whose threshold is null."""
    out = _to_full_recall(df, true, score, positive, weight).select("threshold", (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), F.try_divide("tps", "pos").alias("recall"))
    last = df.sparkSession.range(1).select(F.lit(None).cast(out.schema["threshold"].dataType).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return out.union(last) if end else out


def _to_full_recall(df, true, score, positive, weight) -> DataFrame:
    curve = _curve(df, true, score, positive, weight)
    return curve.filter((F.col("tps") - F.col("tp") < F.col("pos")) | (F.col("pos") == 0) & (F.col("tps") + F.col("fps") == F.col("tp") + F.col("fp")))


def average_precision(df: DataFrame, true: str, score: str, positive=1, weight: str | None = None) -> DataFrame:
    a = F.col("tp") * F.col("tps") / (F.col("tps") + F.col("fps"))
    return _to_full_recall(df, true, score, positive, weight).agg(F.try_divide(F.sum(a), F.max("pos")).alias("average_precision"))


def regression_scores(df: DataFrame, true: str, predicted: str, weight: str | None = None) -> DataFrame:
    """mse, mae and r2 in one pass. Squared gaps from the mean are those of Spark's merged central
    moments where rows have no weights."""
    y, e, w = F.col(true).cast("double"), F.col(true).cast("double") - F.col(predicted), _w(weight)
    mean = F.sum(w * y) / F.sum(w)
    total = F.var_pop(y) * F.count(y) if weight is None else F.sum(w * y * y) - F.sum(w) * mean * mean
    sq = F.sum(w * e * e)
    return df.agg((sq / F.sum(w)).alias("mse"), (F.sum(w * F.abs(e)) / F.sum(w)).alias("mae"), (1 - sq / F.greatest(total, F.lit(1e-20))).alias("r2"))


def multioutput_scores(df: DataFrame, pairs: list[tuple[str, str]], multioutput: str = "uniform", weight: str | None = None) -> DataFrame:
    """mse, mae and r2 of several (true, predicted) columns in one pass: raw_values gives a row for
    each output, uniform their means, variance_weighted weighs r2 by the spread of the outputs."""
    w = _w(weight)
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("output"), F.col(t).cast("double").alias("y"), F.col(p).cast("double").alias("g"), w.alias("w")) for k, (t, p) in enumerate(pairs)])))
    e, mean = F.col("y") - F.col("g"), F.sum(F.col("w") * F.col("y")) / F.sum("w")
    total = F.var_pop("y") * F.count("y") if weight is None else F.sum(F.col("w") * F.col("y") * F.col("y")) - F.sum("w") * mean * mean
    sq = F.sum(F.col("w") * e * e)
    raw = rows.groupBy("output").agg((sq / F.sum("w")).alias("mse"), (F.sum(F.col("w") * F.abs(e)) / F.sum("w")).alias("mae"), (1 - sq / F.greatest(total, F.lit(1e-20))).alias("r2"), total.alias("spread"))
    if multioutput == "raw_values":
        return raw.drop("spread")
    if multioutput not in ("uniform", "variance_weighted"):
        raise ValueError(f"unknown way to join outputs {multioutput!r}")
    r2 = F.avg("r2") if multioutput == "uniform" else F.sum(F.col("r2") * F.col("spread")) / F.sum("spread")
    return raw.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), r2.alias("r2"))


def type_of_target(df: DataFrame, targets: list[str]) -> str:
    """binary (one column of at most two values), multilabel-indicator (several columns of zeros
    and ones) or unknown. Nulls aren't values."""
    row = df.agg(*[F.count_distinct(F.col(t)).alias(f"n{k}") for k, t in enumerate(targets)] if len(targets) == 1 else [F.bool_and(F.col(t).isin(0, 1)).alias(f"n{k}") for k, t in enumerate(targets)]).first()
    if len(targets) == 1:
        return "binary" if row[0] <= 2 else "unknown"
    return "multilabel-indicator" if targets and all(row) else "unknown"


def is_binarized(df: DataFrame, targets: list[str]) -> bool:
    """Whether all values are 0 or 1; true for an empty table."""
    return all(v is not False for v in df.agg(*[F.bool_and(F.col(t).isin(0, 1)).alias(f"b{k}") for k, t in enumerate(targets)]).first())


def log_loss(df: DataFrame, true: str, probability: str, weight: str | None = None, eps: float = 1e-15) -> DataFrame:
    """Mean of -(y log p + (1 - y) log(1 - p)), p kept within eps of 0 and 1."""
    p, y = F.least(F.greatest(F.col(probability), F.lit(eps)), F.lit(1 - eps)), F.col(true).cast("double")
    return df.agg((F.sum(-_w(weight) * (y * F.log(p) + (1 - y) * F.log(1 - p))) / F.sum(_w(weight))).alias("log_loss"))


def cross_entropy(df: DataFrame, true: str, probabilities: str, weight: str | None = None, eps: float = 1e-15) -> DataFrame:
    """Mean of -log of the probability of the true class, whose number (from 0) picks it from an array."""
    p = F.element_at(F.col(probabilities), (F.col(true) + 1).cast("int"))
    return df.agg((F.sum(-_w(weight) * F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0)))) / F.sum(_w(weight))).alias("cross_entropy"))


def averaged_binary(metric, df: DataFrame, pairs: list[tuple[str, str]], average: str = "macro") -> float:
    """A ranking metric over several (true, score) columns: micro pools their rows, macro is the
    mean over the columns, weighted counts each by its positives."""
    if average == "micro":
        pooled = df.select(F.explode(F.array(*[F.struct(F.col(t).cast("double").alias("t"), F.col(s).cast("double").alias("s")) for t, s in pairs])).alias("r")).select("r.*")
        return float(metric(pooled, "t", "s").first()[0])
    values = [float(metric(df, t, s).first()[0]) for t, s in pairs]
    if average == "macro":
        return sum(values) / len(values)
    if average != "weighted":
        raise ValueError(f"unknown average {average!r}")
    row = df.agg(*[F.sum((F.col(t) == 1).cast("double")).alias(f"n{k}") for k, (t, _) in enumerate(pairs)]).first()
    return sum(n * v for n, v in zip(row, values)) / sum(row)
