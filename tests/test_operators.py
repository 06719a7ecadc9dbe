import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import linear as L
from lodestone.operators import metrics as M
from lodestone.operators import neighbors as N
from lodestone.operators import preprocessing as P


def test_partial_fits(spark):
    df = spark.range(100).select((F.col("id") * 3 % 17 - 8.0).alias("x"))
    parts = [df.filter("x < 0"), df.filter("x >= 0"), df.limit(0)]
    for kind in (P.MinMaxScaler, P.MaxAbsScaler, P.StandardScaler):
        whole, merged = kind(["x"]).fit(df), kind(["x"])
        for part in parts:
            merged.partial_fit(part)
        assert merged.shift == pytest.approx(whole.shift) and merged.scale == pytest.approx(whole.scale)


def test_naive_bayes_merges(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("y"), (F.randn(1) + F.col("id") % 3).alias("x"))
    whole, merged = L.GaussianNB(["x"], "y").fit(df), L.GaussianNB(["x"], "y")
    for part in (df.filter("x < 1"), df.filter("x >= 1")):
        merged.partial_fit(part)
    for (a, p, s), (b, q, t) in zip(whole.table, merged.table):
        assert a == b and p == pytest.approx(q) and np.allclose(s, t)


def test_kernel_centerer(spark):
    k = spark.createDataFrame([(i, j, 3.0 * i + j + 1) for i in range(3) for j in range(3)], "i int, j int, k double")
    c = P.KernelCenterer().fit(k)
    assert c.total == 5.0 and c.transform(k).agg(F.max(F.abs("k"))).first()[0] < 1e-12


@pytest.mark.parametrize("values", [7, 2000])
def test_binary_curve(spark, values):
    df = spark.range(3000).select((F.col("id") * 7919 % values / 10.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = [tuple(r) for r in M.binary_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()]
    pdf = df.toPandas().groupby("s")["y"].agg(["sum", "count"]).sort_index(ascending=False).cumsum()
    assert got == [(t, float(r["sum"]), float(r["count"] - r["sum"])) for t, r in pdf.iterrows()]
    assert M.binary_curve(df.limit(0), "y", "s").count() == 0


def test_targets(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (1, 1, 6.0), (1, 0, 7.0)], ["a", "b", "c"])
    assert [M.type_of_target(df, t) for t in (["a"], ["c"], ["a", "b"], ["a", "c"])] == ["binary", "unknown", "multilabel-indicator", "unknown"]
    assert M.is_binarized(df, ["a", "b"]) and not M.is_binarized(df, ["c"]) and M.is_binarized(df.limit(0), ["c"])


def test_averages(spark):
    df = spark.createDataFrame([(0, 0, 0.1, 0.1), (0, 0, 0.4, 0.4), (1, 1, 0.35, 0.35), (1, 1, 0.8, 0.8)], ["a", "b", "s", "t"])
    pairs = [("a", "s"), ("b", "t")]
    for average in ("macro", "weighted", "micro"):
        assert M.averaged_binary(M.roc_auc, df, pairs, average) == pytest.approx(0.75)
    with pytest.raises(ValueError):
        M.averaged_binary(M.roc_auc, df, pairs, "none")


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.8, [0.2, 0.8]), (0, 0.3, [0.7, 0.3])], ["y", "p", "q"])
    want = -(np.log(0.8) + np.log(0.7)) / 2
    assert M.log_loss(df, "y", "p").first()[0] == pytest.approx(want) and M.cross_entropy(df, "y", "q").first()[0] == pytest.approx(want)


def test_neighbors_goldens(spark):
    line = spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 1.0)], ["id", "x"])
    graph = {(r.query_id, r.neighbor_id) for r in N.kneighbors_graph(line, line, "id", ["x"], 2).collect()}
    assert graph == {(0, 0), (0, 2), (1, 1), (1, 2), (2, 0), (2, 2)}
    known = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 1)], ["id", "x", "y"])
    one = spark.createDataFrame([(9, 0.9)], ["id", "x"])
    got = {r.label: r.probability for r in N.kneighbors_proba(known, one, "id", ["x"], "y", 3).collect()}
    assert got == pytest.approx({0: 2 / 3, 1: 1 / 3})
