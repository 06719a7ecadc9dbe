import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import linear as L
from lodestone.operators import metrics as M
from lodestone.operators import neighbors as N
from lodestone.operators import preprocessing as P
from lodestone.operators import ranks as R
from lodestone.plans import selection as S

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("enough", [10, 1_000_000])
def test_quantiles(spark, enough):
    df = spark.range(5000).select(
        F.randn(3).alias("normal"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 11).cast("double").alias("ties"),  # one value holds over a third
        F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, float("nan")).otherwise(F.exp(F.randn(4) * 9)).alias("holes"),
        F.lit(None).cast("double").alias("none"),
        F.lit(2).alias("constant"),
    ).persist()
    pdf = df.toPandas()
    low, mid = (R.quantiles(df, df.columns, SHARES, i, error=0.02, enough=enough) for i in (False, True))
    for c in ("normal", "ties", "holes", "constant"):
        x = np.sort(pdf[c].dropna().to_numpy(float))
        assert low[c] == [x[max(1, math.ceil(s * len(x) - 1e-9)) - 1] for s in SHARES]
        assert mid[c] == pytest.approx(list(np.quantile(x, SHARES)))
    assert low["none"] == mid["none"] == [None] * len(SHARES)
    assert R.most_frequent(df, ["ties", "none"]) == {"ties": 7.0, "none": None}
    assert R.quantiles(df.limit(0), ["normal"], SHARES)["normal"] == [None] * len(SHARES)
    df.unpersist()


def test_numbers_are_gapless_and_do_not_depend_on_partitions(spark):
    df = spark.range(1003)
    got = [{r.id: r["__rank"] for r in R.numbered(df.repartition(n), "id", 5).collect()} for n in (1, 7)]
    assert got[0] == got[1] and sorted(got[0].values()) == list(range(1003))
    assert R.numbered(df.limit(0), "id").count() == 0


def test_folds(spark):
    df = spark.range(103)
    assert sorted(r["count"] for r in S.k_fold(df, "id", 5).groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    train, test = S.train_test_split(df, "id", 0.33)
    assert (train.count(), test.count()) == (103 - math.ceil(103 * 0.33), math.ceil(103 * 0.33)) and train.intersect(test).count() == 0
    assert S.train_test_split(df, "id", 7)[1].count() == 7
    groups = S.group_fold(spark.range(500).select((F.col("id") % 50).alias("g")), "g", 3)
    assert groups.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_running_sums(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 5).alias("x"))
    pdf = df.toPandas()
    for down in (False, True):
        want = pdf.sort_values("v", ascending=not down).set_index("v")["x"].cumsum().to_dict()
        assert {r.v: r.run_x for r in R.running(df, "v", ["x"], down).collect()} == want


def test_curve_ends(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.8), (0, 0.4), (1, 0.35)], ["y", "s"])
    curve = sorted(tuple(r) for r in M.roc_curve(df, "y", "s", origin=True).collect())
    assert curve[-1] == (1.9, 0.0, 0.0) and len(curve) == 5
    assert len(M.roc_curve(df.filter("s < 0.85"), "y", "s", origin=True).collect()) == 3
    assert (None, 1.0, 0.0) in {tuple(r) for r in M.precision_recall_curve(df, "y", "s", end=True).collect()}
    whole = M.auc(M.roc_curve(df, "y", "s")).first().auc
    assert whole == pytest.approx(M.roc_auc(df, "y", "s").first().auc) == pytest.approx(0.25)
    assert M.roc_auc(df.filter("y = 1"), "y", "s").first().auc is None and M.roc_auc(df.limit(0), "y", "s").first().auc is None


def test_outputs_together(spark):
    df = spark.createDataFrame([(0.5, 0.0, 1.0, 2.0), (-1.0, -1.0, 1.0, 2.0), (7.0, 8.0, -6.0, -5.0)], ["a", "ga", "b", "gb"])
    pairs = [("a", "ga"), ("b", "gb")]
    assert M.multioutput_scores(df, pairs).first().mse == pytest.approx(0.708, abs=1e-3)
    assert M.multioutput_scores(df, pairs, "variance_weighted").first().r2 == pytest.approx(0.938, abs=1e-3)
    raw = {r.output: r.mae for r in M.multioutput_scores(df, pairs, "raw_values").collect()}
    assert raw == pytest.approx({0: 0.5, 1: 1.0})


def test_inverses(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", ["x", "y"]), (3.0, 5.0, "b", ["y"]), (4.0, 9.0, "a", [])], ["p", "q", "c", "m"])
    for op, columns in ((P.PolynomialFeatures(["p", "q"]), ["p", "q"]), (P.QuantileTransformer(["p", "q"], 3), ["p", "q"]), (P.LabelBinarizer(["c"], 0, 0), ["c"]), (P.PositionBinarizer(["c"]), ["c"]), (P.MultiLabelBinarizer("m"), ["m"]), (P.LabelEncoder("c"), ["c"])):
        out = op.fit_transform(df)
        made = [c for c in out.columns if c not in df.columns]
        back = op.inverse_transform(out.drop(*columns) if made else out)
        for r, want in zip(back.collect(), df.collect()):
            for c in columns:
                assert r[c] == (pytest.approx(want[c], abs=1e-5) if isinstance(want[c], float) else want[c])
    hot = P.KBinsDiscretizer(["p"], 3, "uniform", "onehot-dense").fit(df)
    assert [tuple(r) for r in hot.transform(df).select("p_0", "p_1", "p_2").collect()] == [(1, 0, 0), (0, 0, 1), (0, 0, 1)]
    assert [r.p for r in hot.inverse_transform(hot.transform(df)).collect()] == [1.5, 3.5, 3.5]


def test_label_encoder_merges(spark):
    df = spark.createDataFrame([(k % 4,) for k in range(10)], ["y"])
    whole, merged = P.LabelEncoder("y").fit(df), P.LabelEncoder("y")
    for part in (df.filter("y > 1"), df.filter("y <= 1")):
        merged.partial_fit(part)
    assert (whole.classes, whole.support) == (merged.classes, merged.support) == ([0, 1, 2, 3], [3, 3, 2, 2])


def test_distances_keep_their_digits():
    a = np.array([[1e8, 1e8], [1e8 + 1, 1e8]])
    assert N.distances(a, a, 2).tolist() == [[0, 1], [1, 0]] and N.distances(a, a, float("inf")).tolist() == [[0, 1], [1, 0]]


def test_fits_far_from_the_origin(spark):
    df = spark.range(200).select((F.lit(1e9) + F.col("id") % 7).alias("x"), F.when(F.col("id") != 5, 3.0 * (F.col("id") % 7)).alias("y"))
    one, many = L.LinearRegression(["x"], "y").fit(df), L.MultiTaskElasticNet(["x"], ["y"], 0.0).fit(df)
    assert one.coef[0] == pytest.approx(3.0) and many.coef[0, 0] == pytest.approx(3.0)
    assert L.LinearRegression(["x"], "y").fit(df.limit(0)).coef[0] == 0
