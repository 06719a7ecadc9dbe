"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
four bits differ in at most four bytes, so they share at least four positional bytes: that
is the guaranteed minimum of the count filter. Posting lists of single bytes hold n/256
rows each, and tallying them pairwise is quadratic; so a list is refined to the values of
three byte positions. The 20 position triples below form a covering design: every set of
four positions contains one of them, so each pair that reaches the minimum meets in a
list. In a list the shared positional bytes of a pair are tallied, pairs under the minimum
are dropped and the rest are verified by Hamming distance. The result is exact.

Hot lists. Equal fingerprints become one class before the index is built, so copies never
meet pairwise. A list is searched breadth first over its not yet reached members, and only
the edges of a spanning forest leave it: a dense list costs about its length, and never
emits pairs. A list of more than ``list_cap`` members is dealt into blocks, each pair of
blocks is a task of its own, and every pair of members still meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, utf8_rows
from .components import connected_components

BITS = 4
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 0..7 such that every four of the eight positions contain one: triples
    inside a part, and two of a part with one of the next part."""
    out = []
    for i, part in enumerate(_PARTS):
        out += combinations(part, 3)
        out += [tuple(sorted((*two, one))) for two in combinations(part, 2) for one in _PARTS[(i + 1) % 3]]
    return sorted(out)


TRIPLES = covering_triples()


def shingle_hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``width`` words, repeats included; one hash of
    the whole sequence if there are fewer words; none for a text without words."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, fp, wordless) with fp the fingerprint's 64 bits as a signed long and t a
    hash of the text, which with the id names a row. A null or wordless text has fingerprint
    zero. Rows with a repeated id keep one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8_rows(b.column(2))
            fp = np.fromiter(map(fingerprint, texts), np.uint64, b.num_rows)
            wordless = np.fromiter((not t or t.isspace() for t in texts), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array(wordless)], names=["doc_id", "t", "fp", "wordless"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, fp long, wordless boolean")


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Of xored fingerprints: tally of shared positional bytes, then the Hamming check of the
    pairs that reach the minimum."""
    out = np.count_nonzero(x.view(np.uint8).reshape(-1, 8), axis=1) <= bits
    kept = np.flatnonzero(out)
    out[kept] = np.bitwise_count(x[kept]) <= bits
    return out


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the link graph on distinct fingerprints."""
    left, right = [], []
    rest = fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = _near(np.ascontiguousarray(rest ^ at), bits)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                queue.extend(found)
                left.append(np.full(len(found), at))
                right.append(found)
    empty = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _list_edges(key: np.ndarray, fp: np.ndarray, bits: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys. Short runs by shifted comparison of the whole
    array, long runs one by one."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    left, right = [], []
    keep = np.repeat((length > 1) & (length <= small), length)
    k, f = key[keep], fp[keep]
    for shift in range(1, small):
        if len(k) <= shift:
            break
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        a, b = f[:-shift][same], f[shift:][same]
        hit = _near(a ^ b, bits)
        left.append(a[hit])
        right.append(b[hit])
    for s, n in zip(start[length > small], length[length > small], strict=True):
        a, b = _forest(fp[s : s + n], bits)
        left.append(a)
        right.append(b)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _runs(bits: int):
    """mapInArrow function over rows sorted by (k, bi, bj): a run may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 4
        for b in batches:
            rows = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(kept, b.columns, strict=True)]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])) + 1
            cut = new[-1] if len(new) else 0
            kept = [c[cut:] for c in rows]
            yield from done([c[:cut] for c in rows])
        yield from done(kept)

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(rows[0]):
            return
        changed = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:3]])
        run_no = np.cumsum(np.r_[False, changed])
        a, b = _list_edges(run_no, np.ascontiguousarray(rows[3]).view(np.uint64), bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = BITS, list_cap: int = 16384) -> DataFrame:
    """(a, b): links between different fingerprints, enough of them to connect whatever
    links of ``bits`` or fewer differing bits connect. ``distinct`` has one column fp."""
    if not 0 <= bits <= 4:
        raise ValueError("the covering design holds for 4 or fewer differing bits")

    def byte(i: int):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    keys = [
        F.lit(c << 24).bitwiseOR(F.shiftleft(byte(x), 16)).bitwiseOR(F.shiftleft(byte(y), 8)).bitwiseOR(byte(z))
        for c, (x, y, z) in enumerate(TRIPLES)
    ]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = postings.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    # Lists of one member hold no pair; they are most lists and go before the sort.
    dealt = postings.join(sizes, "k").withColumn("blocks", F.ceil(F.col("n") / list_cap))
    dealt = dealt.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), "blocks")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("k", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp")
    sorted_lists = dealt.repartition("k", "bi", "bj").sortWithinPartitions("k", "bi", "bj")
    return sorted_lists.mapInArrow(_runs(bits), "a long, b long")


def _named(fps: DataFrame, least, name: str, bits: int) -> DataFrame:
    """(fp, ``name``): the smallest ``least`` of the component of each fingerprint of ``fps``.
    A table made by materialize()."""
    classes = materialize(fps.groupBy("fp").agg(F.min(least).alias("least")), "simhash-classes")
    joined = connected_components(links(classes.select("fp"), bits), "a", "b")
    roots = classes.join(joined, classes.fp == joined.node, "left")
    roots = materialize(roots.select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    # Written, so that the join deals both sides anew and splits a hot component's rows.
    named = materialize(roots.groupBy("root").agg(F.min("least").alias(name)), "simhash-least")
    out = materialize(roots.join(named, "root").select("fp", name), "simhash-named")
    discard(classes, joined, roots, named)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits) and
    component_id, the smallest id that links of ``bits`` or fewer differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. A null id keeps
    its row; it never names a component unless all ids of the component are null. Repeated
    rows stay repeated. An empty table gives an empty result. Other columns are ignored."""
    fps = materialize(fingerprints(docs, id_col, text_col).select("doc_id", "fp"), "simhash")
    by_fp = _named(fps, F.col("doc_id"), "component_id", bits)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(by_fp, "fp").select("doc_id", digits, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that
    with the smallest id (a null id comes last; among rows of one id that of the smallest
    hash of the text; among equal ones any). Rows without a word all stay, and don't link:
    they say nothing about being copies of each other, nor of a text whose fingerprint
    happens to be zero. Rows that repeat an id are told apart by their texts. Columns stay,
    whatever their names; an empty table gives an empty result."""
    fps = materialize(fingerprints(docs, id_col, text_col).filter("not wordless").select("doc_id", "t", "fp"), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    by_fp = _named(fps, key, "stays", BITS)
    rows = fps.groupBy("fp", "doc_id", "t").agg(F.count("*").alias("n")).join(by_fp, "fp")
    same = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("t") == F.col("stays.t"))
    marks = rows.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), (~same).alias("__gone"), (F.col("n") > 1).alias("__many"))
    marks = materialize(marks.filter("__gone or __many"), "simhash-marks")
    discard(fps, by_fp)

    text = F.col(text_col).cast("string")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"))
    joined = lambda m, how: held.join(m, held.id.eqNullSafe(m["__id"]) & (held.t == m["__t"]), how)
    out = joined(marks, "left_anti").select("row.*")
    again = marks.filter("not __gone")
    if not again.isEmpty():
        once = joined(again, "left_semi").groupBy("id", "t").agg(F.first("row").alias("row"))
        out = out.union(once.select("row.*"))
    return out


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
