"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 by (doc_id, hash of the text): a range-partitioned sort written
once, each partition's first number being the rows before it. A Feistel network permutes
the smallest power of four that holds n; a number that leaves 0..n-1 is walked along its
cycle until it is back. The place p of a row gives shard p mod shards and slot p div
shards, and the inverse network gives the row of any shard and slot; neither needs a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SHARDS = 24
SEED = 20
ROUNDS = 6
#: Bytes that each document takes beside its text.
OVERHEAD = 8


class Feistel:
    """A permutation of 0..n-1 that a seed fixes; works on arrays."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(seed).integers(0, 2**63, rounds, dtype=np.uint64)

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _step(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._f(right, key)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._f(left, key), left
        return (left << self.half) | right

    def _walk(self, rows: np.ndarray, step) -> np.ndarray:
        x = np.asarray(rows, np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("a row number isn't below n")
        x = step(x)
        while (out := x >= self.n).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self._step)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self._back)


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their rank from 0 in ``order``, and their count. Rows that tie are
    ranked in any order; nulls come first. The ranges, not a single task, are sorted."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the partition's number and, in 33 bits, the row's.
    ranged = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition of the sort.
    sizes = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first, n = [], 0
    for p, size in sizes:
        first.append((p, n))
        n += size
    offsets = spark.createDataFrame(first, "__part long, __first long")
    out = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__first") + inside).drop("__id", "__part", "__first"), n


def shard_rows(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, shard and slot. Shards differ by one row at most, slots of
    a shard are gapless from 0. Columns of these names in ``rows`` are replaced; an empty
    table gives an empty result; repeated rows take places of their own."""
    kept = rows.drop("row_number", "shard", "slot")
    found, n = numbered(kept, order)
    permutation = Feistel(n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = permutation.place(b.column(1).to_numpy(zero_copy_only=False))
            arrays = [b.column(0), b.column(1), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "row_number", "shard", "slot"])

    packed = found.select(F.struct(*kept.columns).alias("row"), "row_number")
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, row_number long, shard int, slot long").select("row.*", "row_number", "shard", "slot")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 8; a null text has
    none), text_crc32, row_number, shard and slot. Other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
    )
    return shard_rows(materialize(rows, "shard-rows"), ["doc_id", "tie"], shards, seed).drop("tie")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
