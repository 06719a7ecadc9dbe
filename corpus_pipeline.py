"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark
leaks, packing. Each stage takes (spark, docs, sf_dir); docs is what the stage before kept.

All but the last return the columns of their input, further ones and clashing names
included. A null text has no words: the quality rules reject it, as they do empty ones. Rows
with a null or repeated id are documents of their own, told apart by their texts where they
share an id. Very long texts are read whole. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, packing, quality_rules, simhash, substring_dedup
from lodestone.llm._common import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, of equal rows one.
    Rows without a word stay, as they aren't copies of a text."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated paragraphs are cut from the texts; a document that loses
    all its words goes, rows with a null id or text stay as they are."""
    return substring_dedup.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; items without words have none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token pieces of what is left; strings of special tokens are those tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path(), specials=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", pack),
]

#: XXH64, connected components over similarity links and the packing plan aren't SQL; the
#: tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            discard(before)
    return docs
