"""Scores, several targets, weights, searches, pipelines with a scaled target, loaders and generators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import gaussian_process as G
from lodestone.operators import linear as L
from lodestone.operators import neighbors as N
from lodestone.operators import neural as U
from lodestone.operators import preprocessing as P
from lodestone.operators import svm as V
from lodestone.plans import selection as S
from lodestone.sources import datasets as D


def line(spark, n=60):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2)) * [1, 10] + [5, -3]
    y, z = x @ [2.0, -0.5] + 7, x @ [0.0, 1.0] - 1
    rows = [(k, *map(float, r), float(a), float(b), float(a > y.mean())) for k, (r, a, b) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(rows, ["id", "x0", "x1", "y", "z", "c"])


X = ["x0", "x1"]


@pytest.mark.parametrize("model", [L.LinearRegression(X, "y"), L.GradientRegression(X, "y"), L.BayesianRidge(X, "y"), L.MultiOutputRegression(X, ["y", "z"]), L.MultiTaskElasticNet(X, ["y", "z"], 1e-9), L.LogisticRegression(X, "c", 1e-3), V.SVR(X, "y", "id", "linear", c=10.0), G.GaussianProcess(X, "y", "id", G.Constant(100.0) * G.RBF(10.0) + G.White(1e-3))])
def test_scores(spark, model):
    assert model.fit(line(spark)).score(line(spark)) > 0.95


def test_multi_output(spark):
    df = line(spark)
    m = L.MultiOutputRegression(X, ["y", "z"]).fit(df)
    assert np.allclose(m.coef, [[2, -0.5], [0, 1]]) and np.allclose(m.intercept, [7, -1])
    holes = df.withColumn("z", F.when(F.col("id") > 3, F.col("z")))
    assert np.allclose(L.MultiOutputRegression(X, ["y", "z"]).fit(holes).coef, m.coef)
    with pytest.raises(ValueError):
        L.BayesianRidge(X, "y").fit(df.limit(0))


def test_network_of_several_targets(spark):
    df = line(spark).withColumn("x1", F.col("x1") / 10).withColumn("y", F.col("y") / 10).withColumn("z", F.col("z") / 10)
    net = U.MLPRegressor(X, ["y", "z"], (), solver="lbfgs", alpha=0.0, max_iter=200, tol=1e-9).fit(df)
    assert net.score(df) > 0.999
    again = U.MLPRegressor(X, ["y", "z"]).load(net.dump())
    got, want = again.predict(df).orderBy("id").collect(), net.predict(df).orderBy("id").collect()
    assert got == want and {"prediction_0", "prediction_1"} <= set(again.predict(df).columns)


def test_weighted_bayes(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 3), ("b", 5.0, 2), ("b", 7.0, 1), ("c", 9.0, 0), ("a", None, 2)]
    df = spark.createDataFrame(rows, "t string, x double, w int")
    m = L.GaussianNB(["x"], "t", weight="w").fit(df.dropna())
    copies = df.dropna().withColumn("k", F.explode(F.array_repeat(F.lit(0), F.col("w"))))
    want = L.GaussianNB(["x"], "t").fit(copies)
    assert [t[0] for t in m.table] == ["a", "b"]
    for (_, p, s), (_, q, r) in zip(m.table, want.table):
        assert np.allclose(p, q) and np.allclose(s, r)
    out = m.predict_proba(df.dropna()).collect()
    assert all(np.isclose(sum(r.prediction_proba), 1) and np.allclose(np.exp(r.prediction_log_proba), r.prediction_proba) for r in out)
    assert m.score(df.filter("w > 0").dropna()) == 1.0


def test_neighbours(spark):
    df = spark.createDataFrame([(k, float(k), float(10 * k)) for k in range(6)], "id int, x double, y double")
    one = N.kneighbors_mean(df, df.filter("id = 2"), "id", ["x"], "y", 3, lambda d: F.exp(-d))
    w = np.exp([0.0, -1.0, -1.0])
    assert np.isclose(one.first().prediction, w @ [20, 10, 30] / w.sum())
    same = N.radius_neighbors(df.union(df.filter("id = 1").withColumn("id", F.lit(9))), df, "id", ["x"], 0.0)
    assert {(r.query_id, r.neighbor_id) for r in same.collect()} == {*((k, k) for k in range(6)), (1, 9)}


@pytest.mark.parametrize("n,k", [(10, 3), (2, 4), (0, 3)])
def test_ordered_folds(spark, n, k):
    got = {r.id: r.fold for r in S.ordered_fold(spark.range(n), "id", k).collect()}
    want = [f for f in range(k) for _ in range(n // k + (f < n % k))]
    assert [got[i] for i in range(n)] == want


def test_search(spark):
    df = line(spark)
    search = S.GridSearch(L.ridge(X, "y"), "id", {"alpha": [1e6, 0.0]}).fit(df)
    assert search.best_params == {"alpha": 0.0} and search.best_score > 0.999 and search.score(df) > 0.999
    assert np.allclose(search.best_model.coef, [2, -0.5])
    error = lambda d: d.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    lower = S.GridSearch(L.ridge(X, "y"), "id", {"alpha": [1e6, 0.0]}, judge=error, lower_is_better=True).fit(df)
    assert lower.best_params == {"alpha": 0.0} and lower.score(df) < 1e-6
    folds = S.cross_validation(L.LinearRegression(X, "y"), df, "id", ordered=True)
    assert [f.score for f in folds] == sorted((f.score for f in folds), reverse=True)
    assert all(f.fit_seconds > 0 and f.score_seconds > 0 and f.model.coef is not None for f in folds)
    with pytest.raises(ValueError):
        S.set_params(L.ridge(X, "y"), {"beta": 1})


def test_pipeline_with_target(spark):
    df = line(spark)
    pipe = S.make_pipeline(P.StandardScaler(X), L.LinearRegression(X, "y"), target=P.StandardScaler(["y"])).fit(df)
    got = pipe.predict(df).orderBy("id").select("prediction", "y").collect()
    assert np.allclose([r.prediction for r in got], [r.y for r in got]) and pipe.score(df) > 0.999
    assert pipe.predict(df.drop("y")).columns == ["id", "x0", "x1", "z", "c", "prediction"]
    back = pipe.inverse_transform(pipe.transform(df)).orderBy("id").collect()
    assert np.allclose([r.x1 for r in back], [r.x1 for r in df.orderBy("id").collect()])
    other = pipe.clone()
    other.steps[1][1].coef = None
    assert pipe.steps[1][1].coef is not None
    best = S.GridSearch(pipe, "id", {"linearregression__alpha": [1e6, 0.0]}).fit(df)
    assert best.best_params == {"linearregression__alpha": 0.0}


def test_loaders(spark, tmp_path):
    (tmp_path / "iris.json").write_text(json.dumps({"data": [[5.1, 3.5], [4.9, 3.0]], "target": [0, 1], "feature_names": ["a", "b"]}))
    assert [tuple(r) for r in D.load_iris(spark, str(tmp_path)).orderBy("row_id").collect()] == [(0, 5.1, 3.5, 0.0), (1, 4.9, 3.0, 1.0)]
    (tmp_path / "ex2data1.txt").write_text("34.6,78.0,0\n60.2,86.3,1\n")
    assert sorted(map(tuple, D.load_exam_score(spark, str(tmp_path)).collect())) == [(34.6, 78.0, 0.0), (60.2, 86.3, 1.0)]
    (tmp_path / "international-airline-passengers.csv").write_text('"Month","Passengers"\n"1949-01",112\n"1949-02",118\n\nTotals in thousands\n')
    got = D.load_airline_passengers(spark, str(tmp_path)).orderBy("month").collect()
    assert [(str(r.month), r.y0) for r in got] == [("1949-01-01", 112.0), ("1949-02-01", 118.0)]


def test_generators(spark):
    df = D.make_blobs(spark, 3001, 3, 0.5, seed=5, features=2)
    centers = D.blob_centers(3, 2, seed=5)
    assert np.abs(centers).max() <= 10
    rows = df.groupBy("y").agg(F.count("*").alias("n"), F.avg("f0").alias("a"), F.avg("f1").alias("b"), F.stddev("f0").alias("s")).orderBy("y").collect()
    assert [r.n for r in rows] == [1001, 1000, 1000]
    assert np.allclose([(r.a, r.b) for r in rows], centers, atol=0.08) and np.allclose([r.s for r in rows], 0.5, atol=0.05)
    assert sorted(df.repartition(3).collect()) == sorted(D.make_blobs(spark, 3001, 3, 0.5, seed=5).collect())
    data = D.make_regression(spark, 500, 6, 3, bias=2.0, targets=2, seed=4)
    m = L.MultiOutputRegression([f"f{k}" for k in range(6)], ["y0", "y1"]).fit(data)
    assert np.allclose(m.coef, D.regression_coefficients(6, 3, 2, seed=4)) and np.allclose(m.intercept, 2)
    assert sum(c != 0 for c in D.regression_coefficients(6, 3, seed=4)[0]) == 3
