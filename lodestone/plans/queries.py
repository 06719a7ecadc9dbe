"""Registered queries of the library's operators over the test tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import interpolate as I
from ..operators import gaussian_process as G
from ..operators import kdtree as T
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import neural as U
from ..operators import preprocessing as P
from ..operators import svm as V
from ..sources import datasets as D
from ..streaming import partial_fit as W
from . import selection as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *keep: str, digits: int = 6, **named) -> DataFrame:
    return df.select(*keep, *[F.round(c if not isinstance(c, str) else F.col(c), digits).alias(n) for n, c in named.items()])


#: The seeded hash of folds and shuffles: 60 leading bits of an MD5.
_H = "('0x' || md5('0:' || {})[:15])::BIGINT"
ITEM = ("l_orderkey", "l_linenumber")
_ITEM = "l_orderkey, l_linenumber"


@query(f"SELECT {_ITEM}, round((l_quantity - lo) / (hi - lo), 6) AS q FROM lineitem, (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem)")
def min_max_scaler(spark, sf):
    return _r(P.MinMaxScaler(["l_quantity"]).fit_transform(_t(spark, sf, "lineitem")), *ITEM, q="l_quantity")


@query(f"SELECT {_ITEM}, round((l_quantity - m) / s, 6) AS q, round((l_discount - m2) / s2, 6) AS d FROM lineitem, (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_discount) m2, stddev_pop(l_discount) s2 FROM lineitem)")
def standard_scaler(spark, sf):
    return _r(P.StandardScaler(["l_quantity", "l_discount"]).fit_transform(_t(spark, sf, "lineitem")), *ITEM, q="l_quantity", d="l_discount")


@query("SELECT round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var FROM lineitem")
def incremental_mean_and_var(spark, sf):
    df, scaler = _t(spark, sf, "lineitem"), P.StandardScaler(["l_quantity"])
    for part in (df.filter("l_orderkey % 3 = 0"), df.filter("l_orderkey % 3 != 0")):
        scaler.partial_fit(part)
    _, mean, sq = scaler.moments["l_quantity"]
    var = sq / scaler.moments["l_quantity"][0]
    return spark.createDataFrame([(round(mean, 6), round(var, 6))], "mean double, var double")


@query("SELECT s_suppkey, round(s_acctbal / m, 6) AS b FROM supplier, (SELECT max(abs(s_acctbal)) m FROM supplier)")
def max_abs_scaler(spark, sf):
    return _r(P.MaxAbsScaler(["s_acctbal"]).fit_transform(_t(spark, sf, "supplier")), "s_suppkey", b="s_acctbal")


@query(f"SELECT {_ITEM}, round((l_quantity - b) / (c - a), 6) AS q FROM lineitem, (SELECT quantile_disc(l_quantity, 0.25) a, quantile_disc(l_quantity, 0.5) b, quantile_disc(l_quantity, 0.75) c FROM lineitem)")
def robust_scaler(spark, sf):
    return _r(P.RobustScaler(["l_quantity"]).fit_transform(_t(spark, sf, "lineitem")), *ITEM, q="l_quantity")


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS a, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS b FROM part")
def normalizer(spark, sf):
    return _r(P.Normalizer(["p_size", "p_retailprice"]).transform(_t(spark, sf, "part")), "p_partkey", a="p_size", b="p_retailprice")


@query(f"SELECT {_ITEM}, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q FROM lineitem")
def binarizer(spark, sf):
    return _r(P.Binarizer(["l_quantity"], 25).transform(_t(spark, sf, "lineitem")), *ITEM, q="l_quantity")


@query("SELECT p_partkey, round(ln(1 + p_size), 6) AS s, 1.0::DOUBLE AS ones FROM part")
def function_transformer(spark, sf):
    df = P.FunctionTransformer(["p_size"], F.log1p, F.expm1).transform(_t(spark, sf, "part"))
    return _r(P.DummyFeature().transform(df), "p_partkey", s="p_size", ones="ones")


def _holes(spark, sf):
    return _t(spark, sf, "lineitem").select(*ITEM, F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("q"))


@query(f"SELECT {_ITEM}, round(CASE WHEN l_quantity <= 40 THEN l_quantity ELSE m END, 6) AS q FROM lineitem, (SELECT avg(l_quantity) m FROM lineitem WHERE l_quantity <= 40)")
def imputer_mean(spark, sf):
    return _r(P.Imputer(["q"]).fit_transform(_holes(spark, sf)), *ITEM, q="q")


@query(f"SELECT {_ITEM}, CASE WHEN l_quantity <= 40 THEN l_quantity ELSE m END AS q FROM lineitem, (SELECT quantile_disc(l_quantity, 0.5) m FROM lineitem WHERE l_quantity <= 40)")
def imputer_median(spark, sf):
    return P.Imputer(["q"], "median").fit_transform(_holes(spark, sf))


@query(f"SELECT {_ITEM}, CASE WHEN l_quantity <= 40 THEN l_quantity ELSE m END AS q FROM lineitem, (SELECT l_quantity m FROM lineitem WHERE l_quantity <= 40 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def imputer_most_frequent(spark, sf):
    return P.Imputer(["q"], "most_frequent").fit_transform(_holes(spark, sf))


@query("SELECT c_custkey, CAST(least(4, greatest(0, floor((c_acctbal - lo) / ((hi - lo) / 5)))) AS DOUBLE) AS b FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)")
def kbins_uniform(spark, sf):
    return P.KBinsDiscretizer(["b"], 5, "uniform").fit_transform(_t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b")))


@query(f"SELECT {_ITEM}, CAST((l_quantity >= a)::INT + (l_quantity >= b)::INT + (l_quantity >= c)::INT AS DOUBLE) AS q FROM lineitem, (SELECT quantile_disc(l_quantity, 0.25) a, quantile_disc(l_quantity, 0.5) b, quantile_disc(l_quantity, 0.75) c FROM lineitem)")
def kbins_quantile(spark, sf):
    return P.KBinsDiscretizer(["q"], 4).fit_transform(_t(spark, sf, "lineitem").select(*ITEM, F.col("l_quantity").alias("q")))


@query(f"SELECT {_ITEM}, " + ", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_returnflag_{k}" for k, v in enumerate("ANR")) + " FROM lineitem")
def one_hot_encoder(spark, sf):
    df = _t(spark, sf, "lineitem").select(*ITEM, "l_returnflag")
    return P.OneHotEncoder(["l_returnflag"]).fit_transform(df).drop("l_returnflag")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def label_encoder(spark, sf):
    return P.LabelEncoder("o_orderpriority").fit_transform(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query("SELECT s_suppkey, " + ", ".join(f"CAST(list_contains(string_split(lower(s_name), ''), '{v}') AS DOUBLE) AS has_{v}" for v in "er") + " FROM supplier")
def multi_label_binarizer(spark, sf):
    df = _t(spark, sf, "supplier").select("s_suppkey", F.filter(F.split(F.lower("s_name"), ""), lambda c: c.isin("e", "r")).alias("t"))
    enc = P.MultiLabelBinarizer("t").fit(df)
    out = enc.transform(df)
    return out.select("s_suppkey", *[(F.col(f"t_{enc.classes.index(v)}") if v in enc.classes else F.lit(0.0)).alias(f"has_{v}") for v in "er"])


@query("SELECT p_partkey, 1.0::DOUBLE AS poly_0, p_size::DOUBLE AS poly_1, round(p_retailprice, 6) AS poly_2, (p_size * p_size)::DOUBLE AS poly_3, round(p_size * p_retailprice, 4) AS poly_4, round(p_retailprice * p_retailprice, 4) AS poly_5 FROM part")
def polynomial_features(spark, sf):
    out = P.PolynomialFeatures(["p_size", "p_retailprice"]).transform(_t(spark, sf, "part"))
    return out.select("p_partkey", "poly_0", "poly_1", F.round("poly_2", 6).alias("poly_2"), "poly_3", F.round("poly_4", 4).alias("poly_4"), F.round("poly_5", 4).alias("poly_5"))


@query("WITH k AS (SELECT quantile_cont(c_acctbal::DOUBLE, [" + ", ".join(f"{i / 10}" for i in range(11)) + "]) AS k FROM customer) SELECT c_custkey, round(greatest(1e-7, least(1 - 1e-7, CASE WHEN c_acctbal < k[1] THEN 0 "
       + " ".join(f"WHEN k[{i + 2}] > k[{i + 1}] AND c_acctbal <= k[{i + 2}] THEN ({i} + (c_acctbal - k[{i + 1}]) / (k[{i + 2}] - k[{i + 1}])) / 10" for i in range(10)) + " ELSE 1 END)), 6) AS q FROM customer, k")
def quantile_transformer(spark, sf):
    return _r(P.QuantileTransformer(["c_acctbal"]).fit_transform(_t(spark, sf, "customer")), "c_custkey", q="c_acctbal")


@query()
def power_transformer(spark, sf):
    return _r(P.PowerTransformer(["c_acctbal"]).fit_transform(_t(spark, sf, "customer")), "c_custkey", q="c_acctbal")


@query("""WITH RECURSIVE g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_quantity * l_tax) AS c, sum(l_discount * l_discount) AS d, sum(l_discount * l_tax) AS e, sum(l_tax * l_tax) AS f FROM lineitem),
v AS (SELECT 0 AS i, 1.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z UNION ALL SELECT i + 1, p / sqrt(p * p + q * q + r * r), q / sqrt(p * p + q * q + r * r), r / sqrt(p * p + q * q + r * r) FROM (SELECT i, a * x + b * y + c * z AS p, b * x + d * y + e * z AS q, c * x + e * y + f * z AS r FROM v, g WHERE i < 60)),
one AS (SELECT x AS x1, y AS y1, z AS z1 FROM v WHERE i = 60),
u AS (SELECT 0 AS i, 0.0::DOUBLE AS x, 1.0::DOUBLE AS y, 0.0::DOUBLE AS z UNION ALL SELECT i + 1, p / sqrt(p * p + q * q + r * r), q / sqrt(p * p + q * q + r * r), r / sqrt(p * p + q * q + r * r) FROM (SELECT i, p0 - t * x1 AS p, q0 - t * y1 AS q, r0 - t * z1 AS r FROM
  (SELECT *, p0 * x1 + q0 * y1 + r0 * z1 AS t FROM (SELECT i, x1, y1, z1, a * x + b * y + c * z AS p0, b * x + d * y + e * z AS q0, c * x + e * y + f * z AS r0 FROM u, one, g WHERE i < 400)))),
two AS (SELECT x AS x2, y AS y2, z AS z2 FROM u WHERE i = 400)
SELECT l_orderkey, l_linenumber, round(l_quantity * x1 + l_discount * y1 + l_tax * z1, 6) AS a, round((l_quantity * x2 + l_discount * y2 + l_tax * z2) * sign(CASE WHEN abs(y2) >= abs(z2) THEN y2 ELSE z2 END), 6) AS b FROM lineitem, one, two""")
def pca(spark, sf):
    return _r(P.PCA(["l_quantity", "l_discount", "l_tax"], 2).fit_transform(_t(spark, sf, "lineitem")), *ITEM, a="pc_0", b="pc_1")


def _guess(spark, sf):
    flag = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return _t(spark, sf, "lineitem").select(flag.alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), F.col("l_quantity").alias("s"), F.col("l_tax").alias("w"))


_G = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p, l_quantity AS s FROM lineitem)"


@query(f"SELECT round(avg((y = p)::INT), 9) AS accuracy FROM {_G}")
def accuracy_score(spark, sf):
    return _r(M.accuracy(_guess(spark, sf), "y", "p"), digits=9, accuracy="accuracy")


@query(f'SELECT y AS "true", p AS predicted, count(*)::DOUBLE AS n FROM {_G} GROUP BY 1, 2')
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_guess(spark, sf), "y", "p")


@query(f"""WITH c AS (SELECT k AS label, sum((y = k AND p = k)::INT) tp, sum((y = k)::INT) t, sum((p = k)::INT) g FROM {_G}, (SELECT unnest([0, 1]) AS k) GROUP BY k)
SELECT label, round(tp / g, 9) AS "precision", round(tp / t, 9) AS recall, round(2 * (tp / g) * (tp / t) / (tp / g + tp / t), 9) AS fscore, t::DOUBLE AS support FROM c""")
def precision_recall_fscore_support(spark, sf):
    out = M.precision_recall_f(_guess(spark, sf), "y", "p")
    return _r(out, "label", "support", digits=9, precision="precision", recall="recall", fscore="fscore")


_CURVE = f"(SELECT s, sum(sum(y)) OVER (ORDER BY s DESC) AS tps, sum(sum(1 - y)) OVER (ORDER BY s DESC) AS fps, sum(sum(y)) OVER () AS pos, sum(sum(1 - y)) OVER () AS neg FROM {_G} GROUP BY s)"


@query(f"SELECT s AS threshold, round(fps / neg, 9) AS fpr, round(tps / pos, 9) AS tpr FROM {_CURVE}")
def roc_curve(spark, sf):
    return _r(M.roc_curve(_guess(spark, sf), "y", "s"), "threshold", digits=9, fpr="fpr", tpr="tpr")


@query(f"SELECT round(sum((fps - coalesce(lag_f, 0)) / neg * (tps + coalesce(lag_t, 0)) / pos / 2), 9) AS auc FROM (SELECT *, lag(fps) OVER (ORDER BY s DESC) AS lag_f, lag(tps) OVER (ORDER BY s DESC) AS lag_t FROM {_CURVE})")
def roc_auc_score(spark, sf):
    return _r(M.roc_auc(_guess(spark, sf), "y", "s"), digits=9, auc="auc")


@query(f"SELECT round(sum((tps - coalesce(lag_t, 0)) / pos * tps / (tps + fps)), 9) AS average_precision FROM (SELECT *, lag(tps) OVER (ORDER BY s DESC) AS lag_t FROM {_CURVE})")
def average_precision_score(spark, sf):
    return _r(M.average_precision(_guess(spark, sf), "y", "s"), digits=9, average_precision="average_precision")


@query("SELECT round(avg(e * e), 2) AS mse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (sum(l_extendedprice * l_extendedprice) - count(*) * avg(l_extendedprice) * avg(l_extendedprice)), 6) AS r2 FROM (SELECT l_extendedprice, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)")
def regression_scores(spark, sf):
    out = M.regression_scores(_t(spark, sf, "lineitem").withColumn("g", F.col("l_quantity") * 1500), "l_extendedprice", "g")
    return out.select(F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linear_regression(spark, sf):
    m = L.LinearRegression(["l_quantity"], "l_extendedprice").fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(round(float(m.coef[0]), 4), round(m.intercept, 3))], "coef double, intercept double")


@query("SELECT round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1000), 4) AS coef FROM lineitem")
def ridge(spark, sf):
    m = L.ridge(["l_quantity"], "l_extendedprice", 1000.0).fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(round(float(m.coef[0]), 4),)], "coef double")


def _coefs(spark, coef, digits=6):
    return spark.createDataFrame([(k, round(float(c), digits)) for k, c in enumerate(np.ravel(coef))], "k int, coef double")


def _descent(product: str, alphas: str, out: str) -> str:
    """SQL of 300 cycles of coordinate descent with an L1 penalty of alpha * n on a Gram matrix of three columns."""
    names = ("l_quantity", "l_discount", "l_tax")
    gram = [f"{product.format(names[i], names[j])} AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"{product.format(names[i], 'l_extendedprice')} AS b{i}" for i in range(3)]

    def step(j: int, source: str) -> str:
        rho = f"(b{j} - " + " - ".join(f"a{min(i, j)}{max(i, j)} * w{i}" for i in range(3) if i != j) + ")"
        return f"(SELECT * REPLACE (sign({rho}) * greatest(abs({rho}) - alpha * n, 0) / a{j}{j} AS w{j}) FROM {source})"

    return f"""WITH RECURSIVE g AS (SELECT count(*) AS n, {', '.join(gram)} FROM lineitem), c AS (SELECT 0 AS i, unnest({alphas}::DOUBLE[]) AS alpha, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2
UNION ALL SELECT i + 1, alpha, w0, w1, w2 FROM {step(2, step(1, step(0, "(SELECT * FROM c, g WHERE i < 300)")))})
SELECT {out} FROM (SELECT alpha, unnest([0, 1, 2]) AS k, unnest([w0, w1, w2]) AS w FROM c WHERE i = 300)"""


@query(_descent("covar_pop({}, {}) * count(*)", "[1e5]", "k, round(w, 3) AS coef"))
def lasso(spark, sf):
    return _coefs(spark, L.lasso(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1e5).fit(_t(spark, sf, "lineitem")).coef, 3)


@query(_descent("sum({} * {})", "[1.0, 1e4, 1e6]", "(row_number() OVER (ORDER BY alpha, k) - 1)::INT AS k, round(w, 3) AS coef"))
def lasso_path(spark, sf):
    path = L.lasso_path(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [1.0, 1e4, 1e6])
    return _coefs(spark, [c for _, w in path for c in w], 3)


@query("""WITH RECURSIVE g AS (SELECT count(*) AS n, var_pop(l_quantity) * count(*) AS a, covar_pop(l_quantity, l_discount) * count(*) AS c, var_pop(l_discount) * count(*) AS d, covar_pop(l_extendedprice, l_quantity) * count(*) AS p, covar_pop(l_extendedprice, l_discount) * count(*) AS q, var_pop(l_extendedprice) * count(*) AS yy FROM lineitem),
e AS (SELECT 0 AS i, 1.0::DOUBLE AS prior, n / yy AS noise FROM g UNION ALL SELECT i + 1, gamma / (w * w + v * v), (n - gamma) / (yy - 2 * (w * p + v * q) + a * w * w + 2 * c * w * v + d * v * v) FROM
  (SELECT *, noise * ((noise * d + prior) * p - noise * c * q) / det AS w, noise * ((noise * a + prior) * q - noise * c * p) / det AS v, 2 - prior * (noise * (a + d) + 2 * prior) / det AS gamma FROM
    (SELECT *, (noise * a + prior) * (noise * d + prior) - noise * noise * c * c AS det FROM e, g WHERE i < 300)))
SELECT k, round(CASE k WHEN 0 THEN noise * ((noise * d + prior) * p - noise * c * q) ELSE noise * ((noise * a + prior) * q - noise * c * p) END / ((noise * a + prior) * (noise * d + prior) - noise * noise * c * c), 2) AS coef FROM e, g, (SELECT unnest([0, 1]) AS k) WHERE i = 300""")
def bayesian_ridge(spark, sf):
    return _coefs(spark, L.BayesianRidge(["l_quantity", "l_discount"], "l_extendedprice").fit(_t(spark, sf, "lineitem")).coef, 2)


@query("""WITH RECURSIVE r AS (SELECT (l_returnflag = 'N')::INT::DOUBLE AS y, l_quantity AS q, l_discount AS d FROM lineitem), t AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
UNION ALL SELECT i + 1, a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det, b - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
  c - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM
    (SELECT i, a, b, c, sum(p - y) AS g0, sum((p - y) * q) + b AS g1, sum((p - y) * d) + c AS g2, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * q) AS h01, sum(p * (1 - p) * d) AS h02, sum(p * (1 - p) * q * q) + 1 AS h11, sum(p * (1 - p) * q * d) AS h12, sum(p * (1 - p) * d * d) + 1 AS h22
     FROM (SELECT *, 1 / (1 + exp(-(a + b * q + c * d))) AS p FROM t, r WHERE i < 10) GROUP BY i, a, b, c)))
SELECT k, round(CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 6) AS coef FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE i = 10""")
def logistic_regression(spark, sf):
    df = _t(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "N").cast("double"))
    m = L.LogisticRegression(["l_quantity", "l_discount"], "y", 1.0).fit(df)
    return _coefs(spark, [m.intercept, *m.coef])


@query("SELECT l_returnflag AS label, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 6) AS var_l_quantity FROM lineitem GROUP BY 1")
def gaussian_nb(spark, sf):
    return _r(L.GaussianNB(["l_quantity"], "l_returnflag").statistics(_t(spark, sf, "lineitem")), "label", "n", mean_l_quantity="mean_l_quantity", var_l_quantity="var_l_quantity")


@query("""WITH s AS (SELECT l_returnflag AS c, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v, avg(l_discount) AS m2, var_pop(l_discount) AS v2 FROM lineitem GROUP BY 1),
e AS (SELECT count(*) AS t, 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount)) AS x FROM lineitem), r AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem)
SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, arg_max(c, ln(n / t) - ln(v + x) / 2 - ln(v2 + x) / 2 - (q - m) * (q - m) / (2 * (v + x)) - (d - m2) * (d - m2) / (2 * (v2 + x))) AS prediction FROM r, s, e GROUP BY id""")
def gaussian_nb_predict(spark, sf):
    df = _t(spark, sf, "lineitem")
    return L.GaussianNB(["l_quantity", "l_discount"], "l_returnflag").fit(df).predict(df).select(*ITEM, "prediction")


@query("""SELECT query_id, neighbor_id, round(d, 6) AS distance, rank::INT AS rank FROM (
  SELECT a.c_custkey AS query_id, b.c_custkey AS neighbor_id, abs(a.c_acctbal - b.c_acctbal) AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) AS rank
  FROM customer a, customer b WHERE a.c_custkey % 20 = 0) WHERE rank <= 5""")
def k_neighbors(spark, sf):
    df = _t(spark, sf, "customer")
    got = N.kneighbors(df, df.filter("c_custkey % 20 = 0"), "c_custkey", ["c_acctbal"], 5, 1.0)
    return got.select("query_id", "neighbor_id", F.round("distance", 6).alias("distance"), "rank")


@query("""SELECT query_id, neighbor_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def k_neighbors_vectors(spark, sf):
    df = _t(spark, sf, "embeddings")
    return N.kneighbors(df, df.filter("vec_id % 20 = 0"), "vec_id", ["embedding"], 5).select("query_id", "neighbor_id", "rank")


@query("""SELECT query_id, arg_min(label, 1000 * (100 - n) + label) AS prediction FROM (SELECT query_id, label, count(*) AS n FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5 GROUP BY 1, 2) GROUP BY 1""")
def k_neighbors_classifier(spark, sf):
    df = _t(spark, sf, "embeddings")
    return N.kneighbors_vote(df, df.filter("vec_id % 20 = 0"), "vec_id", ["embedding"], "label")


@query("""SELECT query_id, round(avg(y), 6) AS prediction FROM (SELECT a.c_custkey AS query_id, b.c_nationkey AS y, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) AS rank
FROM customer a, customer b WHERE a.c_custkey % 20 = 0) WHERE rank <= 5 GROUP BY 1""")
def k_neighbors_regressor(spark, sf):
    df = _t(spark, sf, "customer")
    return _r(N.kneighbors_mean(df, df.filter("c_custkey % 20 = 0"), "c_custkey", ["c_acctbal"], "c_nationkey", 5, p=1.0), "query_id", prediction="prediction")


@query("SELECT a.s_suppkey AS query_id, b.s_suppkey AS neighbor_id, round(sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + (a.s_nationkey - b.s_nationkey) * (a.s_nationkey - b.s_nationkey)), 6) AS distance FROM supplier a, supplier b WHERE sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + (a.s_nationkey - b.s_nationkey) * (a.s_nationkey - b.s_nationkey)) <= 100")
def radius_neighbors(spark, sf):
    df = _t(spark, sf, "supplier")
    return _r(N.radius_neighbors(df, df, "s_suppkey", ["s_acctbal", "s_nationkey"], 100.0), "query_id", "neighbor_id", distance="distance")


@query("SELECT l_returnflag AS label, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1")
def nearest_centroid(spark, sf):
    m = N.NearestCentroid(["l_quantity", "l_discount"], "l_returnflag").fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(lab, round(float(c[0]), 6), round(float(c[1]), 6)) for lab, c in zip(m.labels, m.centers)], "label string, q double, d double")


@query("""WITH RECURSIVE p AS (SELECT c_custkey, c_acctbal AS x, row_number() OVER (ORDER BY c_custkey) AS r FROM customer),
k AS (SELECT 0 AS i, max(x) FILTER (WHERE r = 1) AS a, max(x) FILTER (WHERE r = 2) AS b, max(x) FILTER (WHERE r = 3) AS c FROM p
  UNION ALL SELECT i + 1, coalesce(avg(x) FILTER (WHERE g = 0), a), coalesce(avg(x) FILTER (WHERE g = 1), b), coalesce(avg(x) FILTER (WHERE g = 2), c) FROM (SELECT i, a, b, c, x, CASE WHEN abs(x - a) <= abs(x - b) AND abs(x - a) <= abs(x - c) THEN 0 WHEN abs(x - b) <= abs(x - c) THEN 1 ELSE 2 END AS g FROM k, p WHERE i < 100) GROUP BY i, a, b, c)
SELECT c_custkey, CASE WHEN abs(x - a) <= abs(x - b) AND abs(x - a) <= abs(x - c) THEN 0 WHEN abs(x - b) <= abs(x - c) THEN 1 ELSE 2 END AS prediction FROM p, k WHERE i = 100""")
def k_means(spark, sf):
    df = _t(spark, sf, "customer")
    return N.KMeans(["c_acctbal"], "c_custkey", 3).fit(df).predict(df).select("c_custkey", "prediction")


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey AS y FROM supplier),
near AS (SELECT a.id AS a, b.id AS b FROM s a, s b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 200),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) > 3), link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, link.b FROM reach, link WHERE reach.b = link.a),
named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)
SELECT s.id, coalesce(own.cluster, min(other.cluster), -1) AS cluster FROM s LEFT JOIN named own ON own.id = s.id LEFT JOIN near ON near.a = s.id LEFT JOIN named other ON other.id = near.b GROUP BY s.id, own.cluster""")
def dbscan(spark, sf):
    return N.dbscan(_t(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], 200.0, 3)


@query("SELECT p_partkey, round(CASE WHEN p_size < 10 THEN 1 + (p_size - 1) * 3.0::DOUBLE / 9 WHEN p_size < 30 THEN 4 + (p_size - 10) * -2.0::DOUBLE / 20 ELSE 2 + (p_size - 30) * 7.0::DOUBLE / 20 END, 6) AS v FROM part")
def interp_1d(spark, sf):
    x = F.col("p_size").cast("double")
    return _t(spark, sf, "part").select("p_partkey", F.round(I.linear(x, [1, 10, 30, 50], [1, 4, 2, 9]), 6).alias("v"))


@query("""WITH g AS (SELECT p_partkey, p_size AS x, p_retailprice AS y, CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS i, CASE WHEN p_retailprice < 1500 THEN 0 ELSE 1 END AS j FROM part),
w AS (SELECT *, CASE i WHEN 0 THEN (x - 1) / 24.0::DOUBLE ELSE (x - 25) / 25.0::DOUBLE END AS u, CASE j WHEN 0 THEN (y - 900) / 600.0::DOUBLE ELSE (y - 1500) / 500.0::DOUBLE END AS v, [[1, 2, 3], [2, 4, 9], [3, 8, 27]] AS z FROM g)
SELECT p_partkey, round((1 - u) * (1 - v) * z[i + 1][j + 1] + u * (1 - v) * z[i + 2][j + 1] + (1 - u) * v * z[i + 1][j + 2] + u * v * z[i + 2][j + 2], 9) AS v FROM w""")
def interp_2d(spark, sf):
    v = I.bilinear(F.col("p_size").cast("double"), F.col("p_retailprice"), [1, 25, 50], [900, 1500, 2000], [[1, 2, 3], [2, 4, 9], [3, 8, 27]])
    return _t(spark, sf, "part").select("p_partkey", F.round(v, 9).alias("v"))


@query("""WITH k AS (SELECT unnest([1, 10, 30]) AS x0, unnest([10, 30, 50]) AS x1, unnest([1, 4, 2]) AS y0, unnest([4, 2, 9]) AS y1, unnest([0::DOUBLE, -262 / 4240, 208.6::DOUBLE / 4240]) AS m0, unnest([-262 / 4240, 208.6::DOUBLE / 4240, 0::DOUBLE]) AS m1)
SELECT p_partkey, round(m0 * (x1 - p_size) ** 3 / (6 * (x1 - x0)) + m1 * (p_size - x0) ** 3 / (6 * (x1 - x0)) + (y0 / (x1 - x0) - m0 * (x1 - x0) / 6) * (x1 - p_size) + (y1 / (x1 - x0) - m1 * (x1 - x0) / 6) * (p_size - x0), 6) AS v
FROM part JOIN k ON p_size >= x0 AND (p_size < x1 OR x1 = 50 AND p_size <= x1)""")
def cubic_spline(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.round(I.cubic_spline(F.col("p_size").cast("double"), [1, 10, 30, 50], [1, 4, 2, 9]), 6).alias("v"))


@query("SELECT p_partkey, round(1 / (1 + exp(-p_size / 50.0::DOUBLE)), 6) AS logistic, round(tanh(p_size / 50.0::DOUBLE), 6) AS tanh, greatest(p_size - 25, 0)::DOUBLE AS relu FROM part")
def activations(spark, sf):
    x = F.col("p_size") / 50.0
    return _t(spark, sf, "part").select("p_partkey", F.round(C.ACTIVATIONS["logistic"](x), 6).alias("logistic"), F.round(C.ACTIVATIONS["tanh"](x), 6).alias("tanh"), C.ACTIVATIONS["relu"]((F.col("p_size") - 25).cast("double")).alias("relu"))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(exp(-1e-6 * (a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal)), 6) AS k FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def rbf_kernel(spark, sf):
    a = _t(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    b = _t(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("y"))
    return a.join(b, "s_nationkey").select("i", "j", F.round(C.kernel("rbf", [F.col("x")], [F.col("y")], 1e-6), 6).alias("k"))


@query(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {_H.format('o_orderkey')}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def k_fold(spark, sf):
    return S.k_fold(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"""WITH r AS (SELECT {_H.format("l_orderkey")} % 3 AS fold, l_quantity AS q, l_extendedprice AS y FROM lineitem), m AS (SELECT f, regr_slope(y, q) FILTER (WHERE fold <> f) AS s, regr_intercept(y, q) FILTER (WHERE fold <> f) AS i FROM r, (SELECT unnest([0, 1, 2]) AS f) GROUP BY f)
SELECT f::INT AS fold, round(1 - sum((y - i - s * q) * (y - i - s * q)) / (var_pop(y) * count(*)), 6) AS score FROM r JOIN m ON fold = f GROUP BY f""")
def cross_validate(spark, sf):
    scores = S.cross_validate(L.LinearRegression(["l_quantity"], "l_extendedprice"), _t(spark, sf, "lineitem"), "l_orderkey")
    return spark.createDataFrame([(k, round(s, 6)) for k, s in enumerate(scores)], "fold int, score double")


@query(f"""WITH r AS (SELECT {_H.format("l_orderkey")} % 2 AS fold, l_quantity AS q, l_extendedprice AS y FROM lineitem), g AS (SELECT unnest([0, 1]) AS f), p AS (SELECT unnest([0.0::DOUBLE, 1e5]) AS alpha),
m AS (SELECT f, alpha, avg(q) AS mq, avg(y) AS my, covar_pop(y, q) * count(*) / (var_pop(q) * count(*) + alpha) AS w FROM r, g, p WHERE fold <> f GROUP BY f, alpha),
s AS (SELECT f, alpha, 1 - sum((y - my - w * (q - mq)) * (y - my - w * (q - mq))) / (var_pop(y) * count(*)) AS score FROM r JOIN m ON fold = f GROUP BY f, alpha) SELECT alpha, round(avg(score), 6) AS score FROM s GROUP BY alpha""")
def grid_search(spark, sf):
    _, results = S.grid_search(L.ridge(["l_quantity"], "l_extendedprice"), _t(spark, sf, "lineitem"), "l_orderkey", {"alpha": [0.0, 1e5]}, 2)
    return spark.createDataFrame([(p["alpha"], round(s, 6)) for p, s in results], "alpha double, score double")


@query("""WITH g AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS c, covar_pop(l_extendedprice, l_quantity) AS p, covar_pop(l_extendedprice, l_discount) AS q, avg(l_quantity) AS m, avg(l_discount) AS m2, avg(l_extendedprice) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(y + (c * p - b * q) / (a * c - b * b) * (l_quantity - m) + (a * q - b * p) / (a * c - b * b) * (l_discount - m2), 3) AS prediction FROM lineitem, g""")
def model_pipeline(spark, sf):
    cols = ["l_quantity", "l_discount"]
    pipe = S.make_pipeline(P.StandardScaler(cols), L.LinearRegression(cols, "l_extendedprice"))
    df = _t(spark, sf, "lineitem")
    return pipe.fit(df).predict(df).select(*ITEM, F.round("prediction", 3).alias("prediction"))


def _normal(stream: int, seed: int = 3) -> str:
    u = "((('0x' || md5('{}:{}:' || i)[:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496)"
    return f"(sqrt(-2 * ln({u.format(seed, 2 * stream)})) * cos(2 * pi() * {u.format(seed, 2 * stream + 1)}))"


@query(f"SELECT i AS row_id, round(5 * (i % 2) + {_normal(0)}, 6) AS f0, round(5 * (i % 2) + {_normal(1)}, 6) AS f1, (i % 2)::INT AS y FROM range(1000) AS t(i)")
def make_blobs(spark, sf):
    return _r(D.make_blobs(spark, 1000, [[0.0, 0.0], [5.0, 5.0]], 1.0, 3), "row_id", "y", f0="f0", f1="f1")


def _coefficient(k: int, target: int, seed: int = 3) -> str:
    return f"100 * ((('0x' || md5('{seed}:{-2 - target}:{k}')[:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


@query("SELECT i AS row_id, " + ", ".join(f"round({_normal(k)}, 6) AS f{k}" for k in range(4)) + ", " + ", ".join(f"round(1 + {_coefficient(0, t)} * {_normal(0)} + {_coefficient(1, t)} * {_normal(1)} + 0.1::DOUBLE * {_normal(4 + t)}, 6) AS y{t}" for t in range(2)) + " FROM range(1000) AS t(i)")
def make_regression(spark, sf):
    return _r(D.make_regression(spark, 1000, 4, 2, 1.0, 0.1, 3, targets=2, shuffle=False), "row_id", **{c: c for c in ("f0", "f1", "f2", "f3", "y0", "y1")})


@query(" UNION ALL ".join(f"SELECT {k} AS output, round(regr_slope({y}, l_quantity), 6) AS coef, round(regr_intercept({y}, l_quantity), 4) AS intercept FROM lineitem" for k, y in enumerate(("l_extendedprice", "l_tax"))))
def multi_output_regression(spark, sf):
    m = L.MultiOutputRegression(["l_quantity"], ["l_extendedprice", "l_tax"]).fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(k, round(float(w[0]), 6), round(float(b), 4)) for k, (w, b) in enumerate(zip(m.coef, m.intercept))], "output int, coef double, intercept double")


@query("""SELECT l_returnflag AS label, round(sum(l_tax), 6) AS n, round(sum(l_tax * l_quantity) / sum(l_tax), 6) AS mean,
round(sum(l_tax * l_quantity * l_quantity) / sum(l_tax) - (sum(l_tax * l_quantity) / sum(l_tax)) * (sum(l_tax * l_quantity) / sum(l_tax)), 6) AS var FROM lineitem GROUP BY 1""")
def gaussian_nb_weighted(spark, sf):
    stats = L.GaussianNB(["l_quantity"], "l_returnflag", weight="l_tax").statistics(_t(spark, sf, "lineitem"))
    return _r(stats, "label", n="n", mean="mean_l_quantity", var="var_l_quantity")


@query("""SELECT o_orderkey, (CASE WHEN k < r * (q + 1) THEN k // (q + 1) ELSE r + (k - r * (q + 1)) // q END)::INT AS fold
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () // 7 AS q, count(*) OVER () % 7 AS r FROM orders)""")
def ordered_k_fold(spark, sf):
    return S.ordered_fold(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("""SELECT l_orderkey, l_linenumber, round(m + s * (l_quantity - t), 3) AS prediction FROM lineitem,
(SELECT avg(l_extendedprice) AS m, regr_slope(l_extendedprice, l_quantity) AS s, avg(l_quantity) AS t FROM lineitem)""")
def target_pipeline(spark, sf):
    pipe = S.make_pipeline(P.StandardScaler(["l_quantity"]), L.LinearRegression(["l_quantity"], "l_extendedprice"), target=P.StandardScaler(["l_extendedprice"]))
    df = _t(spark, sf, "lineitem")
    return pipe.fit(df).predict(df).select(*ITEM, F.round("prediction", 3).alias("prediction"))


_ONE = "(SELECT count(*) AS n, covar_pop(l_extendedprice, l_quantity) * count(*) AS b, covar_pop(l_discount, l_quantity) * count(*) AS b2, var_pop(l_quantity) * count(*) AS a FROM lineitem)"


@query(f"SELECT 0 AS k, round(sign(b) * greatest(abs(b) - 50000 * n, 0) / (a + 50000 * n), 6) AS coef FROM {_ONE}")
def elastic_net(spark, sf):
    return _coefs(spark, L.elastic_net(["l_quantity"], "l_extendedprice", 1e5).fit(_t(spark, sf, "lineitem")).coef)


@query(f"SELECT k, round(CASE k WHEN 0 THEN b ELSE b2 END * greatest(1 - 50 * n / sqrt(b * b + b2 * b2), 0) / (a + 50 * n), 6) AS coef FROM {_ONE}, (SELECT unnest([0, 1]) AS k)")
def multi_task_elastic_net(spark, sf):
    return _coefs(spark, L.MultiTaskElasticNet(["l_quantity"], ["l_extendedprice", "l_discount"], 100.0).fit(_t(spark, sf, "lineitem")).coef)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def gradient_regression(spark, sf):
    m = L.GradientRegression(["l_quantity"], "l_extendedprice").fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(round(float(m.coef[0]), 3), round(m.intercept, 2))], "coef double, intercept double")


def _parts(spark, sf):
    x0, x1 = (F.col("p_size") - 25) / 25, (F.col("p_retailprice") - 1500) / 500
    return _t(spark, sf, "part").select("p_partkey", x0.alias("x0"), x1.alias("x1"), (x0 * x0 + x1 * x1 < 1).cast("double").alias("y"), (x0 - 2 * x1).alias("z"))


@query()
def svc(spark, sf):
    df = _parts(spark, sf)
    return V.SVC(["x0", "x1"], "y", "p_partkey", c=10.0, gamma=1.0).fit(df).predict(df).select("p_partkey", "y", "prediction")


@query()
def svr(spark, sf):
    df = _parts(spark, sf)
    return _r(V.SVR(["x0", "x1"], "z", "p_partkey", "linear", c=10.0).fit(df).predict(df), "p_partkey", digits=2, prediction="prediction")


@query()
def gaussian_process(spark, sf):
    df = _t(spark, sf, "nation")
    m = G.GaussianProcess(["n_nationkey"], "n_regionkey", "n_nationkey", G.Constant(1.0) * G.RBF(2.0) + G.White(0.1)).fit(df)
    return _r(m.predict(df), "n_nationkey", digits=4, mean="prediction", std="prediction_std")


@query()
def mlp_classifier(spark, sf):
    df = _parts(spark, sf)
    return U.MLPClassifier(["x0", "x1"], "y", (8,), "tanh", "lbfgs", max_iter=40).fit(df).predict(df).select("p_partkey", "y", "prediction")


@query()
def mlp_regressor(spark, sf):
    df = _parts(spark, sf)
    return _r(U.MLPRegressor(["x0", "x1"], "z", (8,), "tanh", "adam", rate=0.02, max_iter=20).fit(df).predict(df), "p_partkey", digits=3, prediction="prediction")


_NET = '{"params": {"activation": "tanh"}, "coefs_": [[[0.5, -1.0], [0.25, 2.0]], [[1.5], [-0.75]]], "intercepts_": [[0.1, -0.2], [0.3]]}'


@query("""SELECT p_partkey, round(0.3::DOUBLE + 1.5 * tanh(0.1::DOUBLE + 0.5 * x0 + 0.25 * x1) - 0.75 * tanh(-0.2::DOUBLE - x0 + 2 * x1), 6) AS v
FROM (SELECT p_partkey, (p_size - 25) / 25.0::DOUBLE AS x0, (p_retailprice - 1500) / 500 AS x1 FROM part)""")
def mlp_from_json(spark, sf):
    return _r(U.MLPRegressor(["x0", "x1"], "z").load(_NET).predict(_parts(spark, sf)), "p_partkey", v="prediction")


@query()
def multinomial_logistic(spark, sf):
    df = _t(spark, sf, "lineitem").select(*ITEM, (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), "l_returnflag")
    m = U.multinomial_logistic(["q", "d"], "l_returnflag", 1.0, 30).fit(df)
    return m.predict(df).select(*ITEM, "prediction")


_FLAT = "sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + (a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey))"


@query(f"""SELECT query_id, neighbor_id, round(d, 6) AS distance, rank::INT AS rank FROM (
  SELECT a.c_custkey AS query_id, b.c_custkey AS neighbor_id, {_FLAT} AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY {_FLAT}, b.c_custkey) AS rank
  FROM customer a, customer b WHERE a.c_custkey % 20 = 0) WHERE rank <= 4""")
def kd_tree(spark, sf):
    df = _t(spark, sf, "customer")
    return _r(T.tree_neighbors(df, df.filter("c_custkey % 20 = 0"), "c_custkey", ["c_acctbal", "c_nationkey"], 4), "query_id", "neighbor_id", "rank", distance="distance")


@query('SELECT c AS "column", count(v) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS var FROM (SELECT \'value\' AS c, value AS v FROM events) GROUP BY 1')
def streaming_moments(spark, sf):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp()
    path = f"{shared}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_t(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    W.moments_sink(stream, ["value"], path).awaitTermination()
    return W.read_moments(spark, path).select("column", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, round((a.n_nationkey - m) * (b.n_nationkey - m), 6) + 0::DOUBLE AS k FROM nation a, nation b, (SELECT avg(n_nationkey) AS m FROM nation)")
def kernel_centerer(spark, sf):
    df = _t(spark, sf, "nation")  # 25 rows at every size
    pairs = df.select(F.col("n_nationkey").alias("i")).crossJoin(df.select(F.col("n_nationkey").alias("j")))
    k = pairs.withColumn("k", (F.col("i") * F.col("j")).cast("double"))
    return P.KernelCenterer().fit(k).transform(k).select("i", "j", F.round("k", 6).alias("k"))


@query("SELECT p_partkey, round(p_size / n, 8) AS p_size FROM part, (SELECT sqrt(sum(p_size * p_size)) AS n FROM part)")
def column_normalizer(spark, sf):
    return _r(P.ColumnNormalizer(["p_size"]).fit_transform(_t(spark, sf, "part")), "p_partkey", digits=8, p_size="p_size")


@query("SELECT round(avg(-(y * ln(g) + (1 - y) * ln(1 - g))), 9) AS log_loss FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 51 AS g FROM lineitem)")
def log_loss(spark, sf):
    return _r(M.log_loss(_guess(spark, sf).withColumn("g", F.col("s") / 51), "y", "g"), digits=9, log_loss="log_loss")


@query("""SELECT query_id, neighbor_id, 1.0::DOUBLE AS value FROM (SELECT a.s_suppkey AS query_id, b.s_suppkey AS neighbor_id, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS rank
FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey) WHERE rank <= 3""")
def k_neighbors_graph(spark, sf):
    df = _t(spark, sf, "supplier")
    return N.kneighbors_graph(df, df, "s_suppkey", ["s_acctbal"], 3, 1.0, include_self=False)


@query("""SELECT query_id, label, count(*) / 5 AS probability FROM (SELECT a.c_custkey AS query_id, b.c_mktsegment AS label, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) AS rank
FROM customer a, customer b WHERE a.c_custkey % 20 = 0) WHERE rank <= 5 GROUP BY 1, 2""")
def k_neighbors_proba(spark, sf):
    df = _t(spark, sf, "customer")
    return N.kneighbors_proba(df, df.filter("c_custkey % 20 = 0"), "c_custkey", ["c_acctbal"], "c_mktsegment", 5, p=1.0)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_H.format('o_orderkey')}, o_orderkey) <= ceil(count(*) OVER () * 0.25) AS test FROM orders")
def train_test_split(spark, sf):
    train, test = S.train_test_split(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("test", F.lit(False)).union(test.withColumn("test", F.lit(True)))


@query("SELECT * FROM supplier")
def shuffler(spark, sf):
    return P.shuffled(_t(spark, sf, "supplier"), "s_suppkey", 7)


@query("SELECT t AS event_hour, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS t, event_type FROM events) GROUP BY ALL")
def streaming_windows(spark, sf):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp()
    path = f"{shared}/windows-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_t(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = W.windowed_counts(stream, "ts", ["event_type"])
    W.latest_sink(counts, path).awaitTermination()
    return W.read_latest(spark, path, counts.schema, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("event_hour"), "event_type", "n")


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS b FROM supplier")
def scale(spark, sf):
    return _r(P.scale(_t(spark, sf, "supplier"), ["s_acctbal"]), "s_suppkey", b="s_acctbal")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(var_pop({c}), 6) AS var, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in ("l_quantity", "l_tax")))
def mean_and_deviation(spark, sf):
    return _r(P.mean_and_deviation(_t(spark, sf, "lineitem"), ["l_quantity", "l_tax"]), "column", "n", mean="mean", var="var", std="std")


@query("SELECT c_custkey, " + ", ".join(f"(b = {k})::INT::DOUBLE AS b_{k}" for k in range(5)) + " FROM (SELECT c_custkey, least(4, greatest(0, floor((c_acctbal - lo) / ((hi - lo) / 5)))) AS b FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer))")
def kbins_one_hot(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    return P.KBinsDiscretizer(["b"], 5, "uniform", "onehot-dense").fit_transform(df).drop("b")


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS l_returnflag_{k}" for k, v in enumerate("ANR")) + ", l_returnflag FROM lineitem")
def label_binarizer(spark, sf):
    df = _t(spark, sf, "lineitem").select(*ITEM, "l_returnflag")
    enc = P.LabelBinarizer(["l_returnflag"], -1.0, 1.0).fit(df)
    return enc.inverse_transform(enc.transform(df).drop("l_returnflag"))


@query("WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT s_nationkey % 3 AS v FROM supplier UNION SELECT s_suppkey % 4 FROM supplier)) SELECT s_suppkey, " + ", ".join(f"(s_nationkey % 3 = {k})::INT::DOUBLE AS a_{k}, (s_suppkey % 4 = {k})::INT::DOUBLE AS b_{k}" for k in range(4)) + " FROM supplier")
def position_binarizer(spark, sf):
    df = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("a"), (F.col("s_suppkey") % 4).alias("b"))
    return P.PositionBinarizer(["a", "b"]).fit_transform(df).drop("a", "b")


@query("""SELECT output, round(mse, 2) AS mse, round(mae, 4) AS mae, round(1 - mse * n / s, 6) AS r2 FROM (SELECT 0 AS output, avg((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) AS mse, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, count(*) AS n, var_pop(l_extendedprice) * count(*) AS s FROM lineitem
UNION ALL SELECT 1, avg((l_discount - l_tax) * (l_discount - l_tax)), avg(abs(l_discount - l_tax)), count(*), var_pop(l_discount) * count(*) FROM lineitem)""")
def multioutput_scores(spark, sf):
    df = _t(spark, sf, "lineitem").withColumn("g", F.col("l_quantity") * 1500)
    out = M.multioutput_scores(df, [("l_extendedprice", "g"), ("l_discount", "l_tax")], "raw_values")
    return out.select("output", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(f"SELECT s AS threshold, round(tps / (tps + fps), 9) AS precision, round(tps / pos, 9) AS recall FROM (SELECT *, coalesce(lag(tps) OVER (ORDER BY s DESC), -1) AS lag_t FROM {_CURVE}) WHERE lag_t < pos")
def precision_recall_curve(spark, sf):
    return _r(M.precision_recall_curve(_guess(spark, sf), "y", "s"), "threshold", digits=9, precision="precision", recall="recall")


@query("SELECT round(sum((x - coalesce(px, 0)) * (y + coalesce(py, 0)) / 2), 4) AS auc FROM (SELECT *, lag(x) OVER (ORDER BY x, y) AS px, lag(y) OVER (ORDER BY x, y) AS py FROM (SELECT p_size AS x, p_retailprice AS y FROM part))")
def auc(spark, sf):
    return _r(M.auc(_t(spark, sf, "part"), "p_size", "p_retailprice"), digits=4, auc="auc")


@query("SELECT label, round(d, 6) AS d, round(q, 6) AS q FROM (SELECT l_returnflag AS label, quantile_disc(l_discount, 0.5) AS d, quantile_disc(l_quantity, 0.5) AS q FROM lineitem GROUP BY 1)")
def nearest_median(spark, sf):
    m = N.NearestCentroid(["l_discount", "l_quantity"], "l_returnflag", "manhattan").fit(_t(spark, sf, "lineitem"))
    return spark.createDataFrame([(lab, round(float(c[0]), 6), round(float(c[1]), 6)) for lab, c in zip(m.labels, m.centers)], "label string, d double, q double")
