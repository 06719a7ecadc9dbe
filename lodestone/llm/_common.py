"""Shared helpers: the shared work folder, materialised tables, byte-level words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one
    given to ``setCheckpointDir``. Only a local master may go without (tests): it gets a
    folder of this process, removed at exit. On a cluster such a folder would be another
    one on each machine, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends
    there, so a lost executor costs no recomputation and nothing runs twice. The shuffles
    behind the table are of no use from then on; a collection on the driver lets Spark's
    cleaner delete their files at once rather than at some later one."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by materialize()."""
    for df in tables:
        path = getattr(df, "lodestone_path", None)
        if path:
            drop_path(df.sparkSession, path)


def utf8_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null gives empty bytes."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def text_rows(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """utf8_rows() one by one, for columns whose texts needn't all be copied at once."""
    for k in range(0, len(column), rows):
        yield from utf8_rows(column.slice(k, rows))
