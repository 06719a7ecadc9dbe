"""Published values of small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import interpolate as I
from lodestone.operators import linear as L
from lodestone.operators import metrics as M
from lodestone.operators import neighbors as N
from lodestone.operators import preprocessing as P

STEPS = [[-1, -1], [-2, -1], [-3, -2], [1, 1], [2, 1], [3, 2]]


def frame(spark, x, **more):
    x = np.asarray(x, float).reshape(len(x), -1)
    rows = [(k, *map(float, r), *[v[k] for v in more.values()]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *[f"x{k}" for k in range(x.shape[1])], *more])


def values(df, columns):
    return np.array([[r[c] for c in columns] for r in df.orderBy("id").collect()], float)


@pytest.mark.parametrize("operator, x, want", [
    (P.MinMaxScaler, [[-1, 2], [-0.5, 6], [0, 10], [1, 18]], [[0, 0], [0.25, 0.25], [0.5, 0.5], [1, 1]]),
    (P.StandardScaler, [[0, 0], [0, 0], [1, 1], [1, 1]], [[-1, -1], [-1, -1], [1, 1], [1, 1]]),
    (P.MaxAbsScaler, [[1, 2, 0], [3, -4, 0]], [[1 / 3, 0.5, 0], [1, -1, 0]]),
    (lambda c: P.Binarizer(c, 1.1), [[1, -1, 2], [2, 0, 0], [0, 1, -1]], [[0, 0, 1], [1, 0, 0], [0, 0, 0]]),
    (P.Normalizer, [[1, -1, 2], [2, 0, 0], [0, 1, -1]], [[0.408, -0.408, 0.816], [1, 0, 0], [0, 0.707, -0.707]]),
    (lambda c: P.KBinsDiscretizer(c, 3, "uniform"), [[-2, 1, -4, -1], [-1, 2, -3, -0.5], [0, 3, -2, 0.5], [1, 4, -1, 2]], [[0, 0, 0, 0], [1, 1, 1, 0], [2, 2, 2, 1], [2, 2, 2, 2]]),
    (lambda c: P.PowerTransformer(c, standardize=True), [[1, 2], [3, 2], [4, 5]], [[-1.3162, -0.7071], [0.21, -0.7071], [1.1062, 1.4142]]),
    (lambda c: P.PowerTransformer(c, "box-cox", True), [[1, 2], [3, 2], [4, 5]], [[-1.3327, -0.7071], [0.2565, -0.7071], [1.0762, 1.4142]]),
])
def test_operators(spark, operator, x, want):
    df = frame(spark, x)
    columns = df.columns[1:]
    fitted = operator(columns).fit(df)
    out = fitted.transform(df)
    assert np.allclose(values(out, columns), want, atol=1e-3)
    if isinstance(fitted, (P.MinMaxScaler, P.StandardScaler, P.MaxAbsScaler, P.PowerTransformer)):
        assert np.allclose(values(fitted.inverse_transform(out), columns), x, atol=1e-4)


def test_exponents(spark):
    df = frame(spark, [[1, 2], [3, 2], [4, 5]])
    assert np.allclose(list(P.PowerTransformer(["x0"]).fit(df).exponent.values()), 1.3866817390, atol=1e-4)
    assert np.allclose(list(P.PowerTransformer(["x0"], "box-cox").fit(df).exponent.values()), 1.0517, atol=1e-4)
    # of a column with two values, any exponent far enough below zero is about as likely
    assert P.PowerTransformer(["x1"]).fit(df).exponent["x1"] < -2


def test_robust(spark):
    one = frame(spark, [[9], [10], [12], [13], [19], [20], [21], [22]])
    assert P.RobustScaler(["x0"]).fit(one).scale["x0"] == 10
    three = frame(spark, [[1, 4, 7], [3, 2, 8], [9, 1, 1]])
    fitted = P.RobustScaler(["x0", "x1", "x2"]).fit(three)
    assert list(fitted.shift.values()) == [3, 2, 7]


@pytest.mark.parametrize("strategy, want", [("mean", 4.5), ("median", 3), ("most_frequent", 7)])
def test_imputer(spark, strategy, want):
    df = frame(spark, [[1, 2], [3, 4], [float("nan"), 6], [7, 8], [7, 10]])
    assert P.Imputer(["x0", "x1"], strategy).fit(df).fill["x0"] == want


def test_polynomials(spark):
    out = P.PolynomialFeatures(["x0", "x1", "x2"], 3).transform(frame(spark, [[1, 2, 3]]))
    assert values(out, [f"poly_{k}" for k in range(20)])[0].tolist() == [1, 1, 2, 3, 1, 2, 3, 4, 6, 9, 1, 2, 3, 4, 6, 9, 8, 12, 18, 27]


def test_labels(spark):
    y = spark.createDataFrame([(1,), (2,), (2,), (6,)], ["y"])
    assert P.LabelEncoder("y").fit(y).classes == [1, 2, 6]
    hot = P.OneHotEncoder(["x0", "x1", "x2"]).fit(frame(spark, [[0, 0, 3], [1, 1, 0], [0, 2, 1], [1, 0, 2]]))
    assert [len(v) for v in hot.values.values()] == [2, 3, 4]


def test_pca(spark):
    fitted = P.PCA(["x0", "x1"]).fit(frame(spark, STEPS))
    assert np.allclose(fitted.ratio, [0.992, 0.008], atol=1e-3) and np.allclose(fitted.singular, [6.301, 0.550], atol=1e-3)


def test_classification(spark):
    df = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 1])), ["t", "p"])
    scores = M.precision_recall_f(df, "t", "p")
    assert np.allclose(list(M.averaged(scores).first()), [0.2222, 0.3333, 0.2667], atol=1e-3)
    assert np.allclose(list(M.averaged(scores, "micro").first()), 1 / 3)
    assert M.averaged(M.precision_recall_f(df, "t", "p", 0.5)).first().fscore == pytest.approx(0.238, abs=1e-3)
    cells = M.confusion_matrix(spark.createDataFrame(list(zip([2, 0, 2, 2, 0, 1], [0, 0, 2, 2, 0, 2])), ["t", "p"]), "t", "p")
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 2.0), (1, 2, 1.0), (2, 0, 1.0), (2, 2, 2.0)}


def test_ranking(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], ["y", "s"])
    assert M.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.75)
    assert M.average_precision(df, "y", "s").first()[0] == pytest.approx(0.8333, abs=1e-4)
    curve = [(r.threshold, r.fpr, r.tpr) for r in M.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()]
    assert [c for c in curve if c[0] <= 0.8] == [(0.8, 0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1), (0.1, 1, 1)]


@pytest.mark.parametrize("true, guess, want", [([3, -0.5, 2, 7], [2.5, 0, 2, 8], 0.948), ([1, 2, 3], [1, 2, 3], 1), ([1, 2, 3], [2, 2, 2], 0), ([1, 2, 3], [3, 2, 1], -3)])
def test_r2(spark, true, guess, want):
    got = M.regression_scores(spark.createDataFrame([(float(t), float(g)) for t, g in zip(true, guess)], ["t", "g"]), "t", "g").first()
    assert got.r2 == pytest.approx(want, abs=1e-3)
    if len(true) == 4:
        assert (got.mse, got.mae) == (0.375, 0.5)


def test_neighbors(spark):
    df = frame(spark, STEPS, y=[1, 1, 1, 2, 2, 2])
    got = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in N.kneighbors(df, df, "id", ["x0", "x1"], 2).collect()}
    assert [got[k, 2][0] for k in range(6)] == [1, 0, 1, 4, 3, 4] and all(got[k, 1] == (k, 0) for k in range(6))
    assert np.allclose([got[k, 2][1] for k in range(6)], [1, 1, 2**0.5, 1, 1, 2**0.5])
    known, one = frame(spark, [[0, 0, 0], [0, 0.5, 0], [1, 1, 0.5]]), frame(spark, [[1, 1, 1]])
    near = N.radius_neighbors(known, one, "id", ["x0", "x1", "x2"], 1.6).orderBy("distance").collect()
    assert [(r.neighbor_id, r.distance) for r in near] == [(2, 0.5), (1, 1.5)]
    assert N.NearestCentroid(["x0", "x1"], "y").fit(df).predict(frame(spark, [[-0.8, -1]])).first().prediction == 1
    line = frame(spark, [[0], [1], [2], [3]], y=[0, 0, 1, 1])
    assert N.kneighbors_vote(line, frame(spark, [[1.1]]), "id", ["x0"], "y", 3).first().prediction == 0
    assert N.kneighbors_mean(line, frame(spark, [[1.5]]), "id", ["x0"], "y", 2, "distance").first().prediction == pytest.approx(0.5)


def test_ridge(spark):
    m = L.MultiTaskElasticNet(["x0", "x1"], ["x0", "x1"], 1 / 3, 0.0).fit(frame(spark, [[0, 0], [1, 1], [2, 2]]))
    one = L.ridge(["x0", "x1"], "x0", 1.0).fit(frame(spark, [[0, 0], [1, 1], [2, 2]]))
    assert np.allclose(one.coef, 0.4) and one.intercept == pytest.approx(0.2) and np.allclose(m.coef, 0.4)


def test_interpolation(spark):
    x = spark.createDataFrame([(-1.0,), (1.5,), (2.5,), (5.0,)], ["x"])
    assert [r[0] for r in x.select(I.linear(F.col("x"), [1, 2, 3, 4], [-1, -2, 6, 8])).collect()] == [1, -1.5, 2, 10]
    # a natural spline passes its knots and has no curvature at its ends
    xs, ys, h = [0.0, 1.0, 3.0, 4.0], [1.0, -1.0, 2.0, 0.0], 1e-3
    at = spark.createDataFrame([(v,) for v in [*xs, -h, h, 4 - h, 4 + h]], ["x"])
    got = [r[0] for r in at.select(I.cubic_spline(F.col("x"), xs, ys)).collect()]
    assert np.allclose(got[:4], ys) and abs(got[4] + got[5] - 2 * got[0]) < 1e-7 and abs(got[6] + got[7] - 2 * got[3]) < 1e-7
