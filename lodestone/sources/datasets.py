"""Loaders and generators of numeric tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document with ``data`` (rows of numbers) and ``target``: (row_id, f0.., y)."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.select(F.posexplode(F.arrays_zip("data", "target")).alias("row_id", "r"))
    width = doc.select(F.size(F.col("data")[0])).first()[0]
    return rows.select("row_id", *[F.col("r.data")[k].cast("double").alias(f"f{k}") for k in range(width)], F.col("r.target").cast("double").alias("y"))


def read_csv_matrix(spark: SparkSession, path: str, outputs: int = 1, header: bool = False) -> DataFrame:
    """A CSV of numbers: f0.. and, of the last ``outputs`` columns, y0.."""
    df = spark.read.csv(path, header=header)
    d = len(df.columns) - outputs
    names = [f"f{k}" for k in range(d)] + [f"y{k}" for k in range(outputs)]
    return df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(df.columns, names)])


def load_iris(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_dataset(spark, f"{folder}/iris.json")


def load_wine(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_dataset(spark, f"{folder}/wine.json")


def load_breast_cancer(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_dataset(spark, f"{folder}/breast_cancer.json")


def load_diabetes(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_dataset(spark, f"{folder}/diabetes.json")


def load_boston(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_dataset(spark, f"{folder}/boston.json")


def load_exam_score(spark: SparkSession, folder: str) -> DataFrame:
    """Two marks f0 and f1, and y0: whether the student was admitted."""
    return read_csv_matrix(spark, f"{folder}/ex2data1.txt")


def load_microchip_test(spark: SparkSession, folder: str) -> DataFrame:
    """Two measurements f0 and f1, and y0: whether the chip passed."""
    return read_csv_matrix(spark, f"{folder}/ex2data2.txt")


def load_airline_passengers(spark: SparkSession, folder: str) -> DataFrame:
    """(month date, y0 double): passengers in thousands; the month orders the rows. Lines without
    a number are left out."""
    rows = spark.read.csv(f"{folder}/international-airline-passengers.csv", header=True).toDF("month", "y0")
    return rows.select(F.try_to_timestamp("month", F.lit("yyyy-MM")).cast("date").alias("month"), F.col("y0").try_cast("double").alias("y0")).dropna()


def uniform(row: str, seed: int, stream: int) -> Column:
    """A number in (0, 1) that the row, the seed and the stream decide, however the rows are dealt:
    the 52 leading bits of the MD5 of "seed:stream:row", in the middle of their interval."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), F.col(row).cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def normal(row: str, seed: int, stream: int) -> Column:
    """A standard normal number from the uniform ones of streams 2 * stream and 2 * stream + 1."""
    return F.sqrt(-2 * F.log(uniform(row, seed, 2 * stream))) * F.cos(2 * math.pi * uniform(row, seed, 2 * stream + 1))


def drawn(seed: int, *place: int) -> float:
    """``uniform`` on the driver, for the few numbers that describe a generator."""
    digits = hashlib.md5(":".join(map(str, (seed, *place))).encode()).hexdigest()[:13]
    return (int(digits, 16) + 0.5) / 2.0**52


def regression_coefficients(features: int, informative: int, targets: int = 1, shuffle: bool = True, seed: int = 0) -> list[list[float]]:
    """For each target a coefficient from 0 to 100 for each feature, zero for the uninformative;
    those are the last ones unless ``shuffle`` chooses them."""
    order = sorted(range(features), key=lambda k: drawn(seed, -1, k)) if shuffle else list(range(features))
    chosen = order[: min(informative, features)]
    return [[100 * drawn(seed, -2 - t, k) if k in chosen else 0.0 for k in range(features)] for t in range(targets)]


def make_regression(spark: SparkSession, n: int, features: int = 10, informative: int = 5, bias: float = 0.0, noise: float = 0.0, seed: int = 0, targets: int = 1, shuffle: bool = True) -> DataFrame:
    """(row_id, f0.., y): normal features and linear targets of ``regression_coefficients``, with
    normal noise; y0.. for several targets. Streams of the rows: the features', then the targets'."""
    coefs = regression_coefficients(features, informative, targets, shuffle, seed)
    df = spark.range(n).select(F.col("id").alias("row_id")).select("row_id", *[normal("row_id", seed, k).alias(f"f{k}") for k in range(features)])
    names = ["y"] if targets == 1 else [f"y{t}" for t in range(targets)]
    y = {name: sum([F.col(f"f{k}") * c for k, c in enumerate(w) if c], F.lit(float(bias))) + (normal("row_id", seed, features + t) * noise if noise else 0.0) for t, (name, w) in enumerate(zip(names, coefs))}
    return df.withColumns(y)


def blob_centers(centers: int, features: int = 2, box: tuple[float, float] = (-10.0, 10.0), seed: int = 0) -> list[list[float]]:
    """That many centres, drawn uniformly from a box."""
    return [[box[0] + (box[1] - box[0]) * drawn(seed, -1 - c, k) for k in range(features)] for c in range(centers)]


def make_blobs(spark: SparkSession, n: int, centers: int | Sequence[Sequence[float]] = 3, std: float = 1.0, seed: int = 0, features: int = 2, box: tuple[float, float] = (-10.0, 10.0)) -> DataFrame:
    """(row_id, f0.., y): normal points around the centres given, or around a number of centres
    drawn from ``box``; y is the centre's number, and centres have equally many rows or one more."""
    places = blob_centers(centers, features, box, seed) if isinstance(centers, int) else [[float(v) for v in c] for c in centers]
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % len(places)).cast("int").alias("y"))
    table = F.lit(places)
    return df.select("row_id", *[(table[F.col("y")][k] + normal("row_id", seed, k) * std).alias(f"f{k}") for k in range(len(places[0]))], "y")
