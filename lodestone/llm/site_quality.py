"""Quality by hierarchical empirical Bayes: document evidence, hosts and paths.

A logistic classifier over ratios of a whole text gives each document a probability of
good quality. Hosts and the paths on them are groups of documents: the sum of its
documents' probabilities is a group's evidence. A host's rate is drawn from a global Beta
prior whose mean and strength come from the data by the method of moments, and a path's
rate from a Beta around its host's rate, so sparse sites shrink to their host and sparse
hosts to the whole. A document's posterior adds to its own evidence the log-odds of its
path's rate, computed without the document itself. Groups are summed before they are
shuffled, and each stage is a grouped aggregation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from ._common import materialize

MAX_LABELLED = 20_000
#: How far a path's rate may move a document, in log-odds.
SITE_WEIGHT = 0.5
FEATURES = ("log_words", "word_length", "symbols", "stop_words", "duplicate_lines", "distinct_words", "upper_case", "marks")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct ``row`` beside ``x``, the features in the order of FEATURES;
    ratios with denominator 0 are 0. A null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), quality_rules.words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda t: F.length(F.translate(t, quality_rules.WHITE, "")) > 0)
    base = base.withColumn("lines", lines)
    n, chars = F.size("w"), F.length(F.translate("text", quality_rules.WHITE, ""))
    without = lambda some: F.length("text") - F.length(F.translate("text", some, ""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    stops = F.size(F.filter("w", lambda t: t.isin(quality_rules._STOP_FORMS)))
    x = (
        F.log1p(n),
        F.least(per(chars, n), F.lit(20.0)),
        F.least(per(without(quality_rules.SYMBOLS), n), F.lit(1.0)),
        per(stops, n),
        per(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")),
        per(F.size(F.array_distinct("w")), n),
        per(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        F.least(per(without("!?"), n), F.lit(1.0)),
    )
    return base.select("row", F.array(*[c.cast("double") for c in x]).alias("x"))


class Classifier:
    """Ridge logistic regression on standardised features and their squares, by Newton
    steps; ``prior`` is the labelled share of good documents."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        d = len(FEATURES)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(y) else (np.zeros(d), np.ones(d))
        self.w = np.zeros(2 * d + 1)
        self.w[-1] = np.log(self.prior / (1 - self.prior))
        if not len(y) or y.min() == y.max():
            return
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        a = np.hstack([z, z * z, np.ones((len(z), 1))])
        penalty = np.r_[np.full(2 * d, ridge), 1e-6]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            g = a.T @ (p - y) + penalty * self.w
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            self.w -= np.clip(np.linalg.solve(h, g), -3, 3)

    def logit(self, x):
        """The log-odds as a column over an array column of the features."""
        d = len(FEATURES)
        out = F.lit(float(self.w[-1]))
        for k in range(d):
            z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (x[k] - float(self.mean[k])) / float(self.scale[k])))
            out = out + z * float(self.w[k]) + z * z * float(self.w[d + k])
        return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """Fit on at most ``most`` labelled documents, chosen by a hash of their id. Without
    labels, or with one kind only, the classifier knows the prior alone."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # A hash cut leaves little more than ``most`` rows for the ordering to choose from.
    share = int(1e6 * min(1.0, 1.3 * most / max(1, known.count()) + 1e-6))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` ids, whatever the input.
    rows = features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("x", "row.quality").limit(2 * most).collect()
    x = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES))
    return Classifier(x, np.array([r.quality > 0 for r in rows], float))


def _strength(mean: float, variance: float, noise: float) -> float:
    """Pseudo-counts of a Beta prior whose rates vary as observed beyond sampling noise."""
    between = max(variance - noise, 1e-6)
    return float(np.clip(mean * (1 - mean) / between - 1, 2.0, 1e4))


def posteriors(docs: DataFrame, classifier: Classifier, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, posterior, kept) for each row.
    evidence is the classifier's log-odds, host_rate and path_rate are posterior means of
    good quality, kept means a posterior of at least one half.

    A null host or path is a group of its own, as is an empty one. Null and empty texts
    have the evidence of their features. Repeated rows count as often as they are there.
    An empty table gives an empty result; other columns are ignored."""
    host, path = (F.col(c).cast("string") for c in (host_col, path_col))
    known = features(docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text")))
    known = known.select("row.doc_id", "row.host", "row.path", classifier.logit(F.col("x")).alias("evidence"))
    known = materialize(known.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    paths = materialize(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    # Moments over groups: three numbers each for hosts and paths reach the driver.
    total = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
    mean = float(np.clip(classifier.prior if total is None else total, 0.01, 0.99))
    rate = F.col("host_s") / F.col("host_n")
    spread = hosts.agg(F.avg((rate - mean) ** 2), F.avg(mean * (1 - mean) / F.col("host_n"))).first()
    strength = _strength(mean, spread[0] or 0.0, spread[1] or 0.0)
    host_rate = (F.col("host_s") + strength * mean) / (F.col("host_n") + strength)
    sites = paths.join(hosts.withColumn("host_rate", host_rate), paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    r = F.col("host_rate")
    inner = sites.agg(F.avg((F.col("s") / F.col("n") - r) ** 2), F.avg(r * (1 - r) / F.col("n"))).first()
    path_strength = _strength(mean, inner[0] or 0.0, inner[1] or 0.0)
    sites = materialize(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate"), "sites")

    both = known.join(sites, known.host.eqNullSafe(F.col("h")) & known.path.eqNullSafe(F.col("q")))
    others = (F.col("s") - F.col("p") + path_strength * r) / (F.col("n") - 1 + path_strength)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    log_odds = F.col("evidence") + SITE_WEIGHT * (odds(others) - float(np.log(mean / (1 - mean))))
    posterior = 1 / (1 + F.exp(-log_odds))
    path_rate = (F.col("s") + path_strength * r) / (F.col("n") + path_strength)
    return both.select("doc_id", "host", "path", "evidence", "host_rate", path_rate.alias("path_rate"), posterior.alias("posterior"), (log_odds >= 0).alias("kept"))


def op10_site_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return posteriors(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
