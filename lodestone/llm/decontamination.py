"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a run of whole documents of about ``shard_words`` words inside a task, so no
row moves. Words become integers of the benchmark's vocabulary (all others 0, which
matches nothing); the shard's suffixes are sorted into a suffix array, and every suffix of
every benchmark item is binary-searched in it word by word. That gives each test suffix
its longest verbatim match, and the locations of every window's occurrences.

The suffix array is sparse: a suffix is kept if its first two words occur in this order
in the benchmark, or its first word is a whole item; no other suffix can hold a match of
two words or of a whole item. The benchmark travels to the tasks in blocks of a bounded
number of bytes; more blocks mean more passes in a row over the same tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, text_rows

WINDOW = 10
BLOCK_BYTES = 32_000_000
SHARD_WORDS = 500_000
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MASK = (1 << 22) - 1


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.lower().translate(_WORD_BYTES).split()


class TestSuffixes:
    """The suffixes of a block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = [(str(i), words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in texts for x in ws), 1)}
        self.tokens = np.array([self.vocabulary[x] for _, ws in texts for x in ws] or [0], np.int64)
        self.item_ids = list(dict.fromkeys(i for i, _ in texts))
        number = {i: k for k, i in enumerate(self.item_ids)}
        sizes = np.array([len(w) for _, w in texts], np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.start = np.arange(int(sizes.sum()))
        self.length = ends - self.start
        whole = np.repeat(sizes, sizes)
        # The words of the window that starts here; 0: none does.
        self.need = np.where(self.length >= window, window, np.where(self.length == whole, whole, 0))
        self.item = np.repeat(np.array([number[i] for i, _ in texts], np.int64), sizes)
        self.place = whole - self.length
        self.pairs = np.zeros(_MASK + 1, bool)
        inside = self.length > 1
        self.pairs[_pair(self.tokens[self.start[inside]], self.tokens[self.start[inside] + 1])] = True
        self.single = np.zeros(len(self.vocabulary) + 1, bool)
        self.single[self.tokens[self.start[self.need == 1]]] = True
        self.bits = max(1, int(len(self.vocabulary)).bit_length())


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 2654435761 + b) & _MASK


def suffix_array(shard: np.ndarray, tests: TestSuffixes) -> np.ndarray:
    """Sorted starts of the kept suffixes. A suffix ends before its first 0, as nothing
    matches from there on; suffixes that are equal up to there, or for as long as the
    longest test suffix, stand in any order. ``shard`` ends in enough zeros to look ahead."""
    n = len(shard) - 1
    at = np.flatnonzero(shard[:n])
    at = at[((shard[at + 1] > 0) & tests.pairs[_pair(shard[at], shard[at + 1])]) | tests.single[shard[at]]]
    per = 63 // tests.bits
    deepest = int(tests.length.max(initial=0))

    def key(p: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        out, alive = np.zeros(len(p), np.int64), np.ones(len(p), bool)
        for k in range(per):
            word = shard[np.minimum(p + depth + k, n)] * alive
            alive &= word > 0
            out = (out << tests.bits) | word
        return out, alive

    first, alive = key(at, 0)
    order = np.argsort(first, kind="stable")
    at, first, alive = at[order], first[order], alive[order]
    group = np.cumsum(np.r_[True, first[1:] != first[:-1]]) if len(at) else np.empty(0, np.int64)
    depth, places = per, np.arange(len(at))
    while depth < deepest and len(places):
        size = np.bincount(group)
        tied = alive & (size[group] > 1)
        places, group = places[tied], group[tied]
        if not len(places):
            break
        nxt, alive = key(at[places], depth)
        order = np.lexsort((nxt, group))
        at[places] = at[places][order]
        nxt, group, alive = nxt[order], group[order], alive[order]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        depth += per
    return at


def search(shard: np.ndarray, array: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every test suffix, word by word. For each suffix of the array the
    words of its longest match with any test suffix and the first test suffix that matches
    so far (-1: none); for every test suffix the range of the array that holds the
    occurrences of its window (empty: none)."""
    m, end = len(tests.start), len(shard) - 1
    low, high = np.zeros(m, np.int64), np.full(m, len(array), np.int64)
    longest, by = np.zeros(len(array), np.int64), np.full(len(array), -1)
    first, last = np.zeros(m, np.int64), np.zeros(m, np.int64)
    alive = np.arange(m)
    depth = 0

    def bound(lo: np.ndarray, hi: np.ndarray, word: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = shard[np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, end)]
            go = open_ & ((at <= word) if after else (at < word))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    while len(array):
        alive = alive[tests.length[alive] > depth]
        if not len(alive):
            break
        word = tests.tokens[tests.start[alive] + depth]
        lo = bound(low[alive], high[alive], word, False)
        hi = bound(lo, high[alive], word, True)
        found = lo < hi
        alive, lo, hi = alive[found], lo[found], hi[found]
        low[alive], high[alive] = lo, hi
        depth += 1
        # Ranges of equal words are equal, others of this depth apart: the first of each names all.
        own, which = np.unique(lo, return_index=True)
        size = hi[which] - own
        inside = np.repeat(own - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        longest[inside], by[inside] = depth, np.repeat(alive[which], size)
        whole = tests.need[alive] == depth
        first[alive[whole]], last[alive[whole]] = lo[whole], hi[whole]
    return longest, by, first, last


def _shard_rows(texts: list[np.ndarray], tests: TestSuffixes, least: int) -> tuple[list[list[dict]], list[list[str]], list[int], list[list[dict]]]:
    """Merged hit spans, items with occurring windows, longest match and places of matches
    of ``least`` words and more of each document. ``texts``: word numbers, 0 for words that
    the benchmark doesn't have."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    shard = np.zeros(int(sizes.sum()) + 2, np.int64)
    for s, t in zip(starts, texts, strict=True):
        shard[s : s + len(t)] = t
    array = suffix_array(shard, tests)
    longest, by, first, last = search(shard, array, tests)
    best = np.zeros(len(texts), np.int64)
    owner = np.searchsorted(starts, array, "right") - 1
    np.maximum.at(best, owner, longest)
    order = np.argsort(array)
    order = order[longest[order] > 0]
    # A match that the place before has too, one word longer, isn't one of its own.
    inner = np.r_[False, (np.diff(array[order]) == 1) & (longest[order][1:] + 1 == longest[order][:-1])][: len(order)]
    matches: list[list[dict]] = [[] for _ in texts]
    for k in order[~inner & (longest[order] >= least)].tolist():
        d, n, t = int(owner[k]), int(longest[k]), int(by[k])
        at = int(array[k] - starts[d])
        matches[d].append({"start": at, "end": at + n, "item_id": tests.item_ids[tests.item[t]], "item_start": int(tests.place[t])})
    count = last - first
    which = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = array[first[which] + inside] if len(which) else np.empty(0, np.int64)
    edge = np.zeros(len(shard) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.need[which], -1)
    covered = np.diff(np.r_[0, (np.cumsum(edge) > 0).astype(np.int8), 0])
    opens, closes = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    spans: list[list[dict]] = [[] for _ in texts]
    for d, a, b in zip(np.searchsorted(starts, opens, "right") - 1, opens, closes, strict=True):
        spans[d].append({"start": int(a - starts[d]), "end": int(b - starts[d])})
    items: list[list[str]] = [[] for _ in texts]
    doc = np.searchsorted(starts, at, "right") - 1
    for pair in np.unique(doc * len(tests.item_ids) + tests.item[which]):
        d, i = divmod(int(pair), len(tests.item_ids))
        items[d].append(tests.item_ids[i])
    return spans, items, best.tolist(), matches


_RESULT = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>, longest_match int, matches array<struct<start:int,end:int,item_id:string,item_start:int>>"
_PLACES = [("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32())]
_ARROW = [pa.int64(), pa.list_(pa.struct(_PLACES[:2])), pa.list_(pa.string()), pa.int32(), pa.list_(pa.struct(_PLACES))]


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
    least_match: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the ``carry`` columns), n_words,
    hit_spans (merged [start, end) word ranges inside occurrences of a window), item_ids
    (items with an occurring window, as strings), longest_match (words of the longest
    verbatim match of any test suffix in this document; matches of one word count only for
    items of one word) and matches: the places [start, end) of all matches of ``least_match``
    words and more that don't go on to the left, with a place of the benchmark that has the
    same words (of several one). None of it depends on how documents are dealt into shards.

    ``benchmark`` has item_id and text. Null texts have no words; a null item_id is the
    empty string; equal item ids are one item. Empty tables, repeated rows and other
    columns are fine. Memory in a task is bounded by a shard, or by its longest text."""
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    out = docs.select(F.struct(*carry).alias("row") if carry else F.struct(F.lit(0).alias("none")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["row"].dataType.simpleString()
    for k in range(blocks):
        part = source if blocks == 1 else source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        items = [(r.i, (r.t or "").encode()) for r in part.collect()]
        before, last = out, k == blocks - 1
        out = _one_pass(out, kind, TestSuffixes(items, window), shard_words, least_match, k, last)
        if not last:
            # Written, so that a task holds one block at a time.
            out = materialize(out, "decontamination")
            discard(before)
    return out


def _one_pass(rows: DataFrame, kind: str, tests: TestSuffixes, shard_words: int, least: int, k: int, last: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        get = sent.value.vocabulary.get
        seen = 0
        for b in batches:
            done = 0
            for i, t in enumerate(text_rows(b.column(1))):
                found = words(t)
                texts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
                seen += len(texts[-1]) + 1
                if seen >= shard_words:
                    yield from finish([*kept, b.slice(done, i + 1 - done)], texts)
                    kept, texts, seen, done = [], [], 0, i + 1
            if done < b.num_rows:
                kept.append(b.slice(done) if last is False else b.slice(done).select([j for j in range(b.num_columns) if j != 1]))
        if texts:
            yield from finish(kept, texts)

    def finish(kept: list[pa.RecordBatch], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        spans, items, best, matches = _shard_rows(texts, sent.value, least)
        at = 0
        for b in kept:
            n = b.num_rows
            new = [[len(t) for t in texts[at : at + n]], spans[at : at + n], items[at : at + n], best[at : at + n], matches[at : at + n]]
            if k:
                old = [b.column(b.schema.get_field_index(x)).to_pylist() for x in ("hit_spans", "item_ids", "longest_match", "matches")]
                new[1] = [merge_spans(x + y) for x, y in zip(old[0], new[1], strict=True)]
                new[2] = [list(dict.fromkeys(x + y)) for x, y in zip(old[1], new[2], strict=True)]
                new[3] = [max(x, y) for x, y in zip(old[2], new[3], strict=True)]
                new[4] = [longest_at(x + y) for x, y in zip(old[3], new[4], strict=True)]
            front = ["row"] if last else ["row", "text"]
            columns = [b.column(b.schema.get_field_index(x)) for x in front]
            columns += [pa.array(x, t) for x, t in zip(new, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*front, "n_words", "hit_spans", "item_ids", "longest_match", "matches"])
            at += n

    return rows.mapInArrow(run, f"row {kind}, {'' if last else 'text string, '}{_RESULT}")


def merge_spans(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def longest_at(matches: list[dict]) -> list[dict]:
    """Matches of several blocks without those that lie in another one."""
    out: list[dict] = []
    for x in sorted(matches, key=lambda x: (x["start"], -x["end"])):
        if not out or x["end"] > out[-1]["end"]:
            out.append(x)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns unchanged."""
    found = annotate(docs, benchmark, docs.columns, text_col, window)
    return found.filter(F.size("hit_spans") == 0).select("row.*")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "row.doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r),
spots AS (SELECT r, count(*) AS n_hit
          FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (r) LEFT JOIN spots USING (r)
"""
