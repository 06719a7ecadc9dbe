import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import gaussian_process as G
from lodestone.operators import kdtree as T
from lodestone.operators import linear as L
from lodestone.operators import neighbors as N
from lodestone.operators import neural as U
from lodestone.operators import optimizers as O
from lodestone.operators import svm as V
from lodestone.sources import octave
from lodestone.streaming import partial_fit as W


def frame(spark, x, **more):
    x = np.asarray(x, float)
    names = [f"x{k}" for k in range(x.shape[1])] + list(more)
    rows = [(k, *map(float, r), *[v[k] for v in more.values()]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *names])


def rosenbrock(x):
    a, b = 1 - x[0], x[1] - x[0] ** 2
    return a * a + 100 * b * b, np.array([-2 * a - 400 * x[0] * b, 200 * b])


@pytest.mark.parametrize("method", ["lbfgs", "bfgs", "cg", "neldermead"])
def test_methods(method):
    x, value = O.minimize(rosenbrock, np.array([-1.2, 1.0]), method, 3000, 1e-9)
    assert np.allclose(x, 1, atol=1e-3) and value < 1e-5


@pytest.mark.parametrize("method", [*O.SOLVERS, "gradientdescent"])
def test_step_rules(method):
    target = np.array([1.0, -2.0])
    options = {"step_size": 0.1} if method == "sgd" else {}
    x, _ = O.minimize(lambda x: (((x - target) ** 2).sum(), 2 * (x - target)), np.zeros(2), method, 3000, 1e-9, **options)
    assert np.allclose(x, target, atol=1e-2)


def test_unknown_solver():
    with pytest.raises(ValueError):
        O.solver("newton")


def test_clip():
    rule = O.SGD(step_size=1.0, momentum=0.0, clip=1.0)
    assert np.allclose(rule.step(np.zeros(2), np.array([3.0, 4.0])), -np.array([0.6, 0.8]) * 100 / 101)


def test_multi_task(spark):
    df = frame(spark, [[0, 0], [1, 1], [2, 2]])
    net = L.MultiTaskElasticNet(["x0", "x1"], ["x0", "x1"], 0.1).fit(df)
    # the published values come from a solver that stops early; the optimum is symmetric
    assert np.allclose(net.coef, [[0.45663524, 0.45612256]] * 2, atol=1e-3) and np.allclose(net.intercept, 0.0872422, atol=1e-3)
    w, x = net.coef.T, np.array([[-1.0, -1.0], [0, 0], [1, 1]])
    slope = x.T @ (x @ w - x) / 3 + 0.05 * w + 0.05 * w / np.linalg.norm(w, axis=1, keepdims=True)
    assert np.abs(slope).max() < 1e-8
    lasso = L.multi_task_lasso(["x0", "x1"], ["x0", "x1"], 0.1).fit(df)
    assert np.allclose(lasso.coef, [[0.89393398, 0.0]] * 2, atol=1e-6)


def test_lasso_path(spark):
    df = frame(spark, [[1, 2.3], [2, 5.4], [3.1, 4.3]], y=[1.0, 2.0, 3.1])
    got = [c for _, c in L.lasso_path(df, ["x0", "x1"], "y", [5.0, 1.0, 0.5])]
    # the published values of the last alpha come from a solver that stops early
    assert np.allclose(got, [[0, 0.216], [0, 0.443], [0.474, 0.235]], atol=6e-3)
    x, y = np.array([[1, 2.3], [2, 5.4], [3.1, 4.3]]), np.array([1, 2, 3.1])
    assert np.abs(x.T @ (x @ got[2] - y) / 3 + 0.5).max() < 1e-8
    top = L.alpha_grid(L.moments(df, ["x0", "x1"], "y", False))[0]
    assert np.allclose(L.lasso_path(df, ["x0", "x1"], "y", [top])[0][1], 0)


def test_gradient_regression(spark):
    x = np.random.RandomState(0).normal(size=(200, 3)) * [1, 100, 0.01] + 5
    df = frame(spark, x, y=(x @ [2.0, -0.3, 50.0] + 7).tolist())
    for method in ("lbfgs", "cg", "adam"):
        m = L.GradientRegression(["x0", "x1", "x2"], "y", method=method).fit(df)
        assert np.allclose(m.coef, [2, -0.3, 50], rtol=1e-2), method
    exact = L.ridge(["x0", "x1", "x2"], "y", 10.0).fit(df)
    assert np.allclose(L.GradientRegression(["x0", "x1", "x2"], "y", 10.0).fit(df).coef, exact.coef, rtol=1e-4)


SVM_X = [[0.4, -0.7], [-1.5, -1.0], [-1.4, -0.9], [-1.3, -1.2], [-1.1, -0.2], [-1.2, -0.4], [-0.5, 1.2], [-1.5, 2.1], [1.0, 1.0], [1.3, 0.8], [1.2, 0.5], [0.2, -2.0], [0.5, -2.4], [0.2, -2.3], [0.0, -2.7], [1.3, 2.1]]


@pytest.mark.parametrize("kernel, wanted", [("linear", 0.938), ("poly", 1.0), ("rbf", 1.0)])
def test_svc(spark, kernel, wanted):
    df = frame(spark, SVM_X, y=[-1.0] * 8 + [1.0] * 8)
    got = V.SVC(["x0", "x1"], "y", "id", kernel, gamma=2.0).fit(df).predict(df)
    right = got.agg(F.avg((F.col("prediction") == (F.col("y") > 0).cast("double")).cast("int"))).first()[0]
    assert right >= wanted - 0.001


def test_svc_cascade(spark):
    x = np.random.RandomState(1).uniform(-2, 2, size=(1200, 2))
    y = ((x * x).sum(1) < 1.5).astype(float)
    df = frame(spark, x, y=y.tolist())
    whole = V.SVC(["x0", "x1"], "y", "id", gamma=1.0, c=5.0).fit(df)
    split = V.SVC(["x0", "x1"], "y", "id", gamma=1.0, c=5.0, block=400).fit(df)
    a, b = ([r.d for r in m.decision(df, "d").orderBy("id").collect()] for m in (whole, split))
    assert np.mean(np.sign(a) == np.sign(b)) > 0.99 and np.mean((np.array(b) > 0) == y) > 0.98


def test_svr(spark):
    x = np.linspace(-3, 3, 80)[:, None]
    df = frame(spark, x, y=np.sin(x[:, 0]).tolist())
    got = V.SVR(["x0"], "y", "id", gamma=1.0, c=10.0).fit(df).predict(df)
    assert got.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.12


def test_svm_edges(spark):
    df = frame(spark, SVM_X, y=[1.0] * 16)
    assert V.SVC(["x0", "x1"], "y", "id").fit(df).predict(df).agg(F.min("prediction")).first()[0] == 1.0
    empty = V.SVC(["x0", "x1"], "y", "id").fit(df.limit(0))
    assert empty.predict(df).count() == 16
    holed = df.withColumn("x0", F.when(F.col("id") > 0, F.col("x0")))
    assert V.SVR(["x0", "x1"], "y", "id").fit(holed).predict(holed).filter("prediction IS NULL").count() == 1


def test_gaussian_process(spark):
    x, rng = np.linspace(0.1, 9.9, 20)[:, None], np.random.RandomState(1)
    dy = 0.5 + rng.random_sample(20)
    y = (x * np.sin(x))[:, 0] + rng.normal(0, dy)
    m = G.GaussianProcess(["x0"], "y", "id", G.Constant(1.0, (1e-3, 1e3)) * G.RBF(10.0, (1e-2, 1e2)), dy**2, optimize=False)
    m.fit(frame(spark, x, y=y.tolist()))
    value, grad = m.log_marginal_likelihood(m.kernel.theta)
    assert abs(value + 200.98554) < 1e-3 and np.allclose(grad, [-0.07469, -1.52188], atol=1e-3)
    m.optimize = True
    best = m.fit(frame(spark, x, y=y.tolist())).log_marginal_likelihood()[0]
    assert best > value
    got = m.predict(frame(spark, [[2.5], [50.0]])).orderBy("id").collect()
    mean, cov = m.posterior(np.array([[2.5], [50.0]]))
    assert np.allclose([r.prediction for r in got], mean) and np.allclose([r.prediction_std for r in got], np.sqrt(np.diag(cov)))


@pytest.mark.parametrize("kernel", [G.Constant(2.0) * G.RBF((0.7, 1.5)) + G.White(0.3), (G.DotProduct(0.8) + G.Constant(0.5)) ** 2, G.RBF(0.9) * G.DotProduct(1.3)])
def test_kernel_gradients(kernel):
    a, theta = np.random.RandomState(0).normal(size=(6, 2)), kernel.theta
    for k, got in enumerate(kernel.free_gradients(a)):
        step = np.eye(len(theta))[k] * 1e-6
        slope = (kernel.with_theta(theta + step).matrix(a) - kernel.with_theta(theta - step).matrix(a)) / 2e-6
        assert np.allclose(slope, got, atol=1e-6)


def test_prior(spark):
    m = G.GaussianProcess(["x0"], "y", "id", G.Constant(4.0))
    assert m.predict(frame(spark, [[1.0]])).first()["prediction_std"] == 2.0
    with pytest.raises(ValueError):
        G.GaussianProcess(["x0"], "y", "id", max_rows=2).fit(frame(spark, [[1], [2], [3]], y=[1.0, 2.0, 3.0]))


@pytest.mark.parametrize("output, y", [("identity", [[0.3], [1.0]]), ("logistic", [[0.0], [1.0]]), ("softmax", [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]])])
@pytest.mark.parametrize("activation", U.ACTIVATIONS)
def test_backpropagation(output, y, activation):
    y, x = np.array(y), np.array([[0.5, -1.0], [2.0, 0.3]])
    layers = U.Layers([2, 4, 3, y.shape[1]], activation, output)
    theta = layers.start(3) + 0.05
    _, grad = layers.gradient(theta, x, y)
    for k in range(layers.size):
        step = np.eye(layers.size)[k] * 1e-6
        slope = (layers.gradient(theta + step, x, y)[0] - layers.gradient(theta - step, x, y)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-5


def test_mlp(spark):
    x = np.random.RandomState(0).uniform(-1, 1, size=(400, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)
    df = frame(spark, x, y=y.tolist(), z=(x[:, 0] - 2 * x[:, 1]).tolist()).repartition(4).cache()
    for solver, more in (("lbfgs", {"max_iter": 60}), ("adam", {"rate": 0.05, "max_iter": 40, "batch_size": 20})):
        m = U.MLPClassifier(["x0", "x1"], "y", (12,), "tanh", solver, **more).fit(df)
        right = m.predict(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
        assert right > 0.93, solver
    again = U.MLPClassifier(["x0", "x1"], "y").load(m.dump())
    assert m.predict(df).exceptAll(again.predict(df)).count() == 0
    r = U.MLPRegressor(["x0", "x1"], "z", (8,), "tanh", "sgd", rate=0.05, batch_size=20, max_iter=30, learning_rate="adaptive", early_stopping=True).fit(df)
    assert r.predict(df).agg(F.avg((F.col("prediction") - F.col("z")) ** 2)).first()[0] < 0.05


def test_mlp_edges(spark):
    df = frame(spark, [[0, 1], [1, 0], [2, 2]], y=["a", "b", "c"]).withColumn("x0", F.when(F.col("id") < 2, F.col("x0")))
    m = U.multinomial_logistic(["x0", "x1"], "y", 0.01).fit(df)
    assert [r.prediction for r in m.predict(df).orderBy("id").collect()] == ["a", "b", None]
    with pytest.raises(ValueError):
        U.MLPClassifier(["x0"], "y", solver="newton")
    with pytest.raises(ValueError):
        U.multinomial_logistic(["x0"], "y").fit(df.limit(0))


@pytest.mark.parametrize("p", [1.0, 2.0, float("inf")])
def test_kd_tree(spark, p):
    rng = np.random.RandomState(0)
    x, q = rng.randint(0, 12, size=(500, 3)).astype(float), rng.normal(6, 3, size=(40, 3))
    tree = T.KDTree(x, 5)
    for one in q:
        d = N.distances(one[None, :], x, p)[0]
        got, rows = tree.query(one, 7, p=p)
        assert rows.tolist() == np.lexsort((np.arange(500), np.round(d, 9)))[:7].tolist() or np.allclose(np.sort(d)[:7], got)
        assert tree.query(one, 3, eps=0.5, p=p)[0][-1] <= 1.5 * np.sort(d)[2] + 1e-9
    far = tree.query([100.0] * 3, 2, p=p, upper=1.0)
    assert np.isinf(far[0]).all() and (far[1] == -1).all()


def test_lattice(spark):
    x = [[i, j + 2] for i in range(5) for j in range(6)]
    d, rows = T.KDTree(x, 3).query([2.1, 2.9], 1)
    assert abs(d[0] - 0.141421) < 1e-6 and rows[0] == 13
    assert T.KDTree(x, 3).query([0, 0], 1)[0][0] == 2.0 and T.KDTree(np.zeros((0, 2))).query([0, 0])[1][0] == -1


def test_box():
    box = T.Box(np.array([0.0, 0.0]), np.array([4.0, 2.0]))
    less, more = box.split(0, 1.0)
    assert box.volume() == 8 and less.volume() == 2 and more.volume() == 6
    assert box.min_distance([7, 6]) == 5 and box.min_distance([1, 1]) == 0 and box.max_distance([0, 0], 1) == 6
    assert more.min_distance_box(T.Box(np.array([-2.0, 0.0]), np.array([-1.0, 1.0]))) == 2


def test_neighbors_by_blocks(spark, monkeypatch):
    x = np.random.RandomState(0).normal(size=(300, 2))
    df = frame(spark, x, y=list(range(300)))
    want = N.kneighbors(df, df, "id", ["x0", "x1"], 3, carry="y").orderBy("query_id", "rank").collect()
    monkeypatch.setattr(N, "SENT", 0)
    got = N.kneighbors(df, df, "id", ["x0", "x1"], 3, block=64, carry="y").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.neighbor_id, r.carry) for r in got] == [(r.query_id, r.neighbor_id, r.carry) for r in want]


def test_octave(spark, tmp_path):
    def matrix(name, m):
        head = struct.pack("<i", len(name)) + name.encode() + struct.pack("<iBB", 0, 0, 255) + struct.pack("<i", 6) + b"matrix"
        return head + struct.pack("<iiiB", -2, *m.shape, 7) + m.astype("<f8").tobytes(order="F")

    x, y = np.arange(12.0).reshape(4, 3), np.array([[1.0], [2.0], [3.0], [4.0]])
    body = b"Octave-1-L\x00" + matrix("X", x) + matrix("y", y)
    (tmp_path / "a.mat").write_bytes(body)
    (tmp_path / "b.mat").write_bytes(gzip.compress(body))
    rows = octave.read_octave(spark, str(tmp_path)).orderBy("path", "row_id").collect()
    assert [[r.f0, r.f1, r.f2, r.y] for r in rows] == np.hstack([x, y]).tolist() * 2
    with pytest.raises(ValueError):
        octave.parse_octave(b"something else")


def test_stream_of_batches(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.randn(1) * 3 + 10).alias("v"), F.timestamp_seconds("id").alias("ts"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    W.moments_sink(stream, ["v"], str(tmp_path / "out")).awaitTermination()
    got, want = W.read_moments(spark, str(tmp_path / "out")).first(), df.agg(F.count("v"), F.avg("v"), F.var_pop("v")).first()
    assert got.n == want[0] and abs(got.mean - want[1]) < 1e-9 and abs(got["var"] - want[2]) < 1e-9
    query = W.windowed_counts(stream, "ts", [], "1 minute").writeStream.outputMode("complete").format("memory").queryName("per_minute").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM per_minute").first()[0] == 1000


def test_logistic_regression_says_whether_it_converged(spark):
    rows = spark.createDataFrame([(float(k), float(k > 4)) for k in range(10)], "x double, y double")
    assert not L.LogisticRegression(["x"], "y").fit(rows).converged
    mixed = spark.createDataFrame([(float(k), float(k % 3 > 0)) for k in range(30)], "x double, y double")
    assert L.LogisticRegression(["x"], "y").fit(mixed).converged
    none = L.LogisticRegression(["x"], "y").fit(rows.limit(0))
    assert none.intercept == 0 and list(none.coef) == [0] and not none.converged


def test_neighbors_of_many_batches_equal_brute_force(spark):
    import numpy as np
    from lodestone.operators import neighbors

    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, (3000, 2)).astype(float)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = neighbors.kneighbors(df, df.filter("id < 50"), "id", ["a", "b"], 7, block=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    want = {(q, int(n), r + 1) for q in range(50) for r, n in enumerate(np.lexsort((np.arange(3000), d[q]))[:7])}
    assert {(r.query_id, r.neighbor_id, r.rank) for r in got} == want
    assert neighbors.kneighbors(df, df.limit(0), "id", ["a", "b"], 7).count() == 0
