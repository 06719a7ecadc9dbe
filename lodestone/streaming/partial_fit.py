"""Incremental statistics of streams.

Each micro-batch writes its moments (count, mean, sum of squared gaps) as one folder named by
the batch, so that a batch run again after a failure replaces its own; reading merges them. The
state of the fit is in the shared folder, not in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moments_sink(stream: DataFrame, columns: list[str], path: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query; ``path`` gets the folders ``moments`` and ``checkpoint``. Nulls and NaN
    aren't counted."""
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]

    def write(batch: DataFrame, batch_id: int) -> None:
        long = batch.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("x")) for c, v in zip(columns, values)])).alias("r")).select("r.*")
        out = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))
        out.write.mode("overwrite").parquet(f"{path}/moments/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """(column, n, mean, var) of all batches so far."""
    parts = spark.read.schema("column string, n long, mean double, m2 double, batch long").parquet(f"{path}/moments").filter("n > 0")
    total = parts.groupBy("column").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("b")
    )
    spread = F.aggregate("b", F.lit(0.0), lambda s, r: s + r["m2"] + r["n"] * (r["mean"] - F.col("mean")) ** 2)
    return total.select("column", "n", "mean", (spread / F.col("n")).alias("var"))


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by window and keys, rows later than ``late`` behind the newest are left out."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def latest_sink(counts: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Writes each batch's changed groups as one folder named by the batch, so that a batch run
    again replaces its own; ``path`` gets the folders ``latest`` and ``checkpoint``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/latest/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last written row of each group."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/latest")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
