"""Matrices of binary files that GNU Octave's `save -binary` writes, gzipped or not."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"Octave-1-L"
#: Fixed values of the format: the code of a named type, and numpy types by the code that precedes the elements.
NAMED, ELEMENTS = 255, {0: "u1", 1: "<u2", 2: "<u4", 3: "i1", 4: "<i2", 5: "<i4", 6: "<f4", 7: "<f8"}


def parse_octave(content: bytes) -> dict[str, np.ndarray]:
    """Real matrices and scalars by name; other types raise ValueError."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if content[:10] != MAGIC:
        raise ValueError("not a little-endian Octave binary file")
    at, out = 11, {}

    def take(fmt: str):
        nonlocal at
        got = struct.unpack_from(f"<{fmt}", content, at)
        at += struct.calcsize(f"<{fmt}")
        return got if len(got) > 1 else got[0]

    def text() -> str:
        n = take("i")
        return bytes(take(f"{n}s")).decode() if n else ""

    while at < len(content):
        name, _, _, kind = text(), text(), take("B"), take("B")
        kind = text() if kind == NAMED else {1: "scalar", 2: "matrix"}.get(kind, str(kind))
        if kind == "matrix":
            first = take("i")
            dims = [take("i") for _ in range(-first)] if first < 0 else [first, take("i")]
        elif kind == "scalar":
            dims = [1, 1]
        else:
            raise ValueError(f"{name}: type {kind} isn't a real matrix")
        dtype = np.dtype(ELEMENTS[take("B")])
        n = int(np.prod(dims))
        out[name] = np.frombuffer(content, dtype, n, at).astype(float).reshape(dims, order="F")
        at += n * dtype.itemsize
    return out


def read_octave(spark: SparkSession, path: str, x: str = "X", y: str | None = "y") -> DataFrame:
    """(path, row_id, f0.. [, y]) of the matrices ``x`` and ``y`` of each file of ``path``. A
    file is the unit of work; its width is read from the first one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.limit(1).collect()
    if not first:
        raise ValueError(f"no file at {path}")
    width = parse_octave(bytes(first[0].content))[x].shape[1]
    names = [f"f{k}" for k in range(width)] + (["y"] if y else [])

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                got = parse_octave(bytes(content))
                m = np.hstack([got[x], got[y].reshape(len(got[x]), -1)[:, :1]]) if y else got[x]
                out = pd.DataFrame(m, columns=names)
                out.insert(0, "row_id", np.arange(len(m)))
                out.insert(0, "path", where)
                yield out

    fields = ", ".join(f"{n} double" for n in names)
    return files.mapInPandas(rows, f"path string, row_id long, {fields}").select("path", "row_id", *[F.col(n) for n in names])
