"""Substring dedup by paragraph MinHash banding.

A text has paragraphs of two kinds.

(a) Its lines of ``MIN_WORDS`` words or more, and runs of shorter lines up to a blank or a
long one, joined, if they have that many words together (a hard-wrapped paragraph). They
are compared by word 5-shingles: MinHash signatures of BANDS x ROWS values find paragraphs
that collide in a band, the exact Jaccard similarity of the shingle sets verifies them, and
connected components over the verified links form classes. Eight bands of three rows find
a pair at similarity 0.8 with probability 0.997. Of each class the first occurrence
(smallest doc_id, then place) stays.

(b) Every run of ``PASSAGE`` (49) words, wherever it begins, since a repeated passage is often
pasted into the middle of a line. Such a run is the set of its windows of ``ANCHOR`` words,
its MinHash is the window with the smallest hash, and it is a band of its own: equal runs
have equal MinHashes, so each pair of them collides. Over all runs of a text these minima
are few (two in 35 words); only they are rows. Of the places that share a MinHash, its
anchors, each is compared with the earlier ones word for word, to both sides, as far as a
run of PASSAGE words that holds the anchor can reach: the longest agreement with any of
them is a match, and the earliest of those that reach as far is its partner. What matches
cover without a gap is a repeated passage if it has PASSAGE words; its later occurrences
go, and its words are reported at the partners too. So every passage of 49 words that
occurs twice is found and cut to its last word.

Words are compared by hashes of 64 bits, neighbours of anchors by 32 bits of them. Equal
lines become one class before banding. A band's list is searched breadth first over its
not yet reached members and emits a spanning forest, never all pairs; a list of more than
``list_cap`` members is dealt into pairs of blocks. Neighbours of anchors are compared in
tries: a group of up to ``list_cap`` places in one task, a larger one after it was split
by what agrees with its earliest place and how far, as often as needed. All that groups is
pre-aggregated. The large joins are sort-merge joins at every size, so that what a small
input costs says what a large one does. Texts are moved once: for the neighbours of repeated anchors and the
shingles of paragraphs that collide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, text_rows
from .components import connected_components

MIN_WORDS = 24
PASSAGE = 49
ANCHOR = 16
WINNOW = PASSAGE - ANCHOR + 1
REACH = PASSAGE - ANCHOR
SHINGLE = 5
BANDS, ROWS = 8, 3
SIMILARITY = 0.8
LIST_CAP = 2000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C, _D = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _rng.integers(0, 2**63, REACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C
    x = (x ^ (x >> np.uint64(29))) * _D
    return x ^ (x >> np.uint64(32))


def _grams(x: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """Hashes of the n successive values that start at each place, by doubling."""
    out, have, size, power = None, 0, 1, x
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = len(x) - have - size + 1
                out = _mix(out[:m] * by + power[have : have + m])
            have += size
        size *= 2
        if size > n:
            return out
        m = max(0, len(power) - size // 2)
        power = _mix(power[:m] * by + power[size // 2 : size // 2 + m])


def _running(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n successive values."""
    size = 1
    while 2 * size <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Words:
    """The words of a run of texts as one array of hashes. Between texts stands a gap, so
    that what belongs to a text can be told by place.

    x: word hashes, 0 in gaps; starts, sizes: of each text's words in x; lines: rows
    (text, start, end) of the lines of MIN_WORDS words or more and of the joined runs of
    shorter ones, start and end in x."""

    def __init__(self, texts: list[bytes]):
        digest = xxhash.xxh64_intdigest
        gap = [0] * WINNOW
        flat: list[int] = []
        starts, sizes, lines = [], [], []
        for k, text in enumerate(texts):
            starts.append(len(flat))
            run, many = len(flat), 0
            for line in text.lower().split(b"\n"):
                w = line.split()
                if not 0 < len(w) < MIN_WORDS:
                    if many > 1 and len(flat) - run >= MIN_WORDS:
                        lines.append((k, run, len(flat)))
                    if w:
                        lines.append((k, len(flat), len(flat) + len(w)))
                    run, many = len(flat) + len(w), 0
                else:
                    many += 1
                flat += map(digest, w)
            if many > 1 and len(flat) - run >= MIN_WORDS:
                lines.append((k, run, len(flat)))
            sizes.append(len(flat) - starts[-1])
            flat += gap
        self.x = np.array(flat, np.uint64)
        self.starts, self.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.lines = np.array(lines, np.int64).reshape(-1, 3)

    def inside(self, n: int) -> np.ndarray:
        """Whether n words of one text start at each place."""
        many = self.sizes >= n
        edge = np.zeros(len(self.x) + 1, np.int64)
        edge[self.starts[many]] += 1
        edge[self.starts[many] + self.sizes[many] - n + 1] -= 1
        return np.cumsum(edge)[:-1] > 0

    def line_hashes(self, by: np.uint64) -> np.ndarray:
        """A hash of all the words of each line, in their order."""
        if not len(self.lines):
            return np.empty(0, np.uint64)
        _, s, e = self.lines.T
        size = e - s
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        words = self.x[np.repeat(s, size) + place]
        return _mix(np.add.reduceat(_mix(words * by + place.astype(np.uint64) * _D), first) + size.astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, texts and hashes of the MinHashes of all runs of PASSAGE words.

        Where a text repeats itself within ANCHOR words (a word over and over), all windows
        are smallest; of such a stretch the first, the last and one in WINNOW are taken."""
        grams = _grams(self.x, ANCHOR, _A)
        n = len(grams)
        if n < WINNOW:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        hashes = np.where(self.inside(ANCHOR)[:n], grams, np.uint64(2**64 - 1))
        at = _winnowed(hashes, self.inside(PASSAGE)[: n - WINNOW + 1])
        h = grams[at]
        new = np.r_[True, (h[1:] != h[:-1]) | (np.diff(at) >= ANCHOR)][: len(at)]
        begin = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step = (at - begin) // WINNOW
        keep = new | np.r_[new[1:], True][: len(at)] | np.r_[True, step[1:] != step[:-1]][: len(at)]
        at, h = at[keep], h[keep]
        return at, np.searchsorted(self.starts, at, "right") - 1, h

    def bands(self) -> np.ndarray:
        """A row of band keys for each line."""
        m = len(self.lines)
        out = np.arange(BANDS, dtype=np.uint64) * np.ones((m, 1), np.uint64)
        if not m:
            return out
        grams = _grams(self.x, SHINGLE, _A)
        _, s, e = self.lines.T
        size = e - s - SHINGLE + 1
        first = np.cumsum(size) - size
        g = grams[np.repeat(s - first, size) + np.arange(int(size.sum()))]
        for k in range(BANDS * ROWS):
            v = g * _MULTIPLY[k] + _ADD[k]
            v ^= v >> np.uint64(31)
            band = k // ROWS
            out[:, band] = _mix(out[:, band] * _A + np.minimum.reduceat(v, first))
        return out


def _winnowed(hashes: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest of some WINNOW successive ones, of those starts
    for which ``full`` holds."""
    if len(hashes) < WINNOW:
        return np.empty(0, np.int64)
    low = np.where(full, _running(hashes, WINNOW, np.minimum), np.uint64(0))
    pad = np.zeros(WINNOW - 1, np.uint64)
    reach = _running(np.concatenate([pad, low, pad]), WINNOW, np.maximum)
    return np.flatnonzero((reach == hashes) & (reach > 0))


def _slices(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``size`` bytes, with the row of their first one."""
    begin, run, seen = 0, [], 0
    for k, text in enumerate(text_rows(column)):
        run.append(text)
        seen += len(text)
        if seen >= size:
            yield begin, run
            begin, run, seen = k + 1, [], 0
    if run:
        yield begin, run


UNITS = "doc_id long, t long, start int, end int, h1 long, h2 long, bands array<long>"
_DETAILS = "side int, g long, c long, doc_id long, t long, start int, hot boolean, data binary"
_PLACE = "g long, doc_id long, t long, start int, side int, c long, data binary, base int, p_doc_id long, p_t long, p_start int"
_MATCH = "doc_id long, t long, start int, side int, length int, p_doc_id long, p_t long, p_start int"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of the columns of a schema of plain types; lists may hold None."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """UNITS rows from (doc_id, t, text): paragraphs with bands, and a row without for each
    different anchor of a text, with its hash in h1 and its number in start."""
    for b in batches:
        for begin, texts in _slices(b.column(2)):
            words = Words(texts)
            _, text, h = words.anchors()
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(h)])
            many, text, h = np.diff(np.r_[new, len(h)]), text[new], h[new]
            line_text, s, e = words.lines.T
            if not len(text) + len(s):
                continue
            rows = pa.array(np.r_[text, line_text] + begin)
            none = np.r_[np.ones(len(h), bool), np.zeros(len(s), bool)]
            start = np.r_[many, s - words.starts[line_text]]
            end = np.r_[np.zeros(len(h), np.int64), e - words.starts[line_text]]
            offsets = np.r_[np.zeros(len(h), np.int64), np.arange(len(s) + 1) * BANDS]
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words.bands().view(np.int64).ravel()), mask=pa.array(none))
            h1 = np.r_[h, words.line_hashes(_A)].astype(np.uint64).view(np.int64)
            h2 = np.r_[np.zeros(len(h), np.uint64), words.line_hashes(_B)].astype(np.uint64).view(np.int64)
            arrays = [b.column(0).take(rows), b.column(1).take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32(), mask=none), pa.array(h1), pa.array(h2, mask=none), bands]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "start", "end", "h1", "h2", "bands"])


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_DETAILS rows from (doc_id, t, text, anchors, lines). side 0 and 1: the REACH words
    before (nearest first) and behind each place of the asked anchors, as 32-bit hashes,
    0 past the text; c is a hash of them, and a task gives ``data`` with the first of equal
    ones only, but always for hot anchors. side 2: the 5-shingles of the asked lines."""
    seen: set[int] = set()
    for b in batches:
        for begin, texts in _slices(b.column(2)):
            words = Words(texts)
            asked = b.column(3).slice(begin, len(texts))
            owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(asked), 0).to_numpy())
            flat = asked.flatten()
            wanted = _mix(flat.field(0).to_numpy().view(np.uint64) * _B + owner.astype(np.uint64))
            order = np.argsort(wanted)
            wanted, hot = wanted[order], flat.field(1).to_numpy(zero_copy_only=False)[order]
            at, text, h = words.anchors()
            key = _mix(h * _B + text.astype(np.uint64))
            where = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
            found = wanted[where] == key if len(wanted) else np.zeros(len(key), bool)
            at, text, h, hot = at[found], text[found], h[found], hot[where[found]] if len(wanted) else np.empty(0, bool)
            x = np.r_[np.zeros(REACH, np.uint32), (words.x >> np.uint64(32)).astype(np.uint32), np.zeros(PASSAGE, np.uint32)]
            doc_id, t = (b.column(k).take(pa.array(text + begin)).to_numpy() for k in (0, 1))
            start = at - words.starts[text]
            size = words.sizes[text]
            step = np.arange(REACH)
            for side in (0, 1):
                near = x[(at + REACH - 1)[:, None] - step] if side == 0 else x[(at + REACH + ANCHOR)[:, None] + step]
                room = start if side == 0 else size - start - ANCHOR
                near[step >= room[:, None]] = 0
                c = _mix((near.astype(np.uint64) * _PLACES).sum(axis=1, dtype=np.uint64) + np.uint64(side))
                g = _mix(h + np.uint64(side))
                data: list[bytes | None] = [None] * len(g)
                for k, (name, keep) in enumerate(zip(_mix(g * _A + c).tolist(), hot.tolist(), strict=True)):
                    if keep or name not in seen:
                        seen.add(name)
                        data[k] = near[k].tobytes()
                if len(seen) > 500_000:
                    seen.clear()
                if len(g):
                    yield _batch(_DETAILS, [np.full(len(g), side), g.view(np.int64), c.view(np.int64), doc_id, t, start, hot, data])
            lines = [r for k in range(len(texts)) for r in ((k, *y.values()) for y in b.column(4)[begin + k].as_py() or [])]
            if lines:
                grams = _grams(words.x, SHINGLE, _A)
                packed = [grams[words.starts[k] + s : words.starts[k] + e - SHINGLE + 1].tobytes() for k, s, e, _, _ in lines]
                none = [None] * len(lines)
                yield _batch(_DETAILS, [[2] * len(lines), [r[3] for r in lines], [r[4] for r in lines], none, none, none, none, packed])


def _columns(batch: pa.RecordBatch, names: list[str]) -> list:
    """Columns as arrays (null numbers 0), binary ones as lists."""
    out = []
    for n in names:
        c = batch.column(batch.schema.get_field_index(n))
        out.append(c.to_pylist() if pa.types.is_binary(c.type) else pc.fill_null(c, 0).to_numpy(zero_copy_only=False))
    return out


def _words_in(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint32).reshape(-1, REACH)


def _earlier(g: np.ndarray, c: np.ndarray, data: list) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of (g, place): the words of the longest agreement with an
    earlier row of the group and the first row that agrees so far (-1: the first itself)."""
    n = len(g)
    _, first, kind = np.unique(_mix(g.view(np.uint64) * _A + c.view(np.uint64)), return_index=True, return_inverse=True)
    have = np.array([k for k, d in enumerate(data) if d is not None])
    _, one = np.unique(kind[have], return_index=True)
    x = _words_in([data[k] for k in have[one]])
    length, partner = np.full(n, -1), np.full(n, -1)
    later = np.arange(n) != first[kind]
    ends = np.where((x == 0).any(axis=1), (x == 0).argmax(axis=1), REACH)
    length[later], partner[later] = ends[kind[later]], first[kind[later]]
    order = np.argsort(first)
    rows, x = first[order], x[order]
    active, node = np.arange(len(rows)), g[rows].view(np.uint64)
    for k in range(REACH + 1):
        if k:
            word = x[active, k - 1]
            live = word > 0
            active, node = active[live], (node[live] << np.uint64(32)) | word[live]
        _, least, at, many = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        best = rows[active[least[at]]] if len(active) else rows[:0]
        here = rows[active]
        other = best != here
        length[here[other]], partner[here[other]] = k, best[other]
        again = many[at] > 1
        active, node = active[again], at[again].astype(np.uint64)
        if not len(active):
            break
    return length, partner


def _matches(batches: Iterator[pa.RecordBatch], size: int = 60_000) -> Iterator[pa.RecordBatch]:
    """_MATCH rows from _PLACE rows sorted by (g, doc_id, t, start). A match of a text with
    itself counts only if the two places can't overlap however far they reach."""
    names = [f.split(" ")[0] for f in _PLACE.split(", ")]
    kept: list | None = None

    def join(a: list | None, b: list) -> list:
        return b if a is None else [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(a, b, strict=True)]

    def done(rows: list) -> Iterator[pa.RecordBatch]:
        g, doc_id, t, start, side, c, data, base, *given = rows
        if not len(g):
            return
        length, partner = _earlier(g, c, data)
        first = partner < 0
        p = [np.where(first, own, col[partner]) for own, col in zip(given, (doc_id, t, start), strict=True)]
        length = np.where(first, base, length)
        own = (p[0] == doc_id) & (p[1] == t)
        ok = (length >= 0) & ~(own & (start - p[2] < ANCHOR + 2 * REACH))
        if ok.any():
            yield _batch(_MATCH, [v[ok] for v in (doc_id, t, start, side, length, *p)])

    for b in batches:
        kept = join(kept, _columns(b, names))
        if len(kept[0]) >= size:
            end = int(np.flatnonzero(np.r_[True, kept[0][1:] != kept[0][:-1]])[-1])
            yield from done([v[:end] for v in kept])
            kept = [v[end:] for v in kept]
    if kept is not None:
        yield from done(kept)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_PLACE rows and ``done`` from such rows beside the earliest place of their group
    (q_doc_id, q_t, q_start, q_data): the new group is what agrees with that as far and goes
    on with the same word; places that can agree no further with any are done."""
    names = [f.split(" ")[0] for f in _PLACE.split(", ")]
    for b in batches:
        g, doc_id, t, start, side, c, data, base, *given = _columns(b, names)
        *q, q_data = _columns(b, ["q_doc_id", "q_t", "q_start", "q_data"])
        x, y = _words_in(data), _words_in(q_data)
        same = (x == y) & (x > 0)
        length = np.where(same.all(axis=1), REACH, same.argmin(axis=1))
        word = np.where(length < REACH, x[np.arange(len(x)), np.minimum(length, REACH - 1)], 0)
        self_ = (q[0] == doc_id) & (q[1] == t) & (q[2] == start)
        g = _mix(_mix(g.view(np.uint64) * _A + length.astype(np.uint64)) * _B + word).view(np.int64)
        p = [np.where(self_, a, z) for a, z in zip(given, q, strict=True)]
        place = _batch(_PLACE, [g, doc_id, t, start, side, c, data, np.where(self_, base, length), *p])
        yield pa.RecordBatch.from_arrays([*place.columns, pa.array(self_ | (word == 0))], names=[*names, "done"])


def passage_matches(details: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """_MATCH rows: for each side of each place of a repeated anchor that isn't its first,
    the words that agree with an earlier place, and the earliest that agrees so far. A table
    made by materialize()."""
    none = {"base": ("int", -1), "p_doc_id": ("long", None), "p_t": ("long", None), "p_start": ("int", None)}
    columns = [f.split(" ")[0] for f in _PLACE.split(", ")]
    places = details.filter("side < 2").withColumns({c: F.lit(v).cast(k) for c, (k, v) in none.items()})
    ready = places.filter("not hot").select(columns)
    state, made = places.filter("hot").select(columns), []
    matches = None
    while True:
        sizes = materialize(state.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > list_cap).select("g"), "anchor-groups")
        made.append(sizes)
        if sizes.isEmpty():
            ready = ready.union(state)
            break
        large = state.join(sizes, "g")
        least = F.min(F.struct("doc_id", "t", "start", "data")).alias("q")
        pivots = large.groupBy("g").agg(least).select("g", *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("doc_id", "t", "start", "data")])
        # Written, so that the join deals both sides anew and splits a hot group's rows.
        pivots = materialize(pivots, "anchor-pivots")
        ready = ready.union(state.join(sizes, "g", "left_anti"))
        split = materialize(large.join(pivots, "g").mapInArrow(_split, f"{_PLACE}, done boolean"), "anchor-split")
        made += [pivots, split]
        over = ANCHOR + 2 * REACH
        end = split.filter(f"done and base >= 0 and not (p_doc_id = doc_id and p_t = t and start - p_start < {over})")
        end = end.select("doc_id", "t", "start", "side", F.col("base").alias("length"), "p_doc_id", "p_t", "p_start")
        matches = end if matches is None else matches.union(end)
        state = split.filter("not done").select(columns)
    ready = ready.repartition("g").sortWithinPartitions("g", "doc_id", "t", "start")
    found = ready.mapInArrow(_matches, _MATCH)
    out = materialize(found if matches is None else found.union(matches), "passage-matches")
    discard(*made)
    return out


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose Jaccard similarity is high enough."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    size = np.array([len(s) for s in sets])
    rest = np.arange(1, len(sets))
    edges, queue = [], [0]
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        # Members whose size alone rules the similarity out needn't be compared.
        near = rest[np.minimum(size[rest], size[at]) >= similarity * np.maximum(size[rest], size[at]) - 1e-9]
        if len(near):
            wanted = np.zeros(len(sets), bool)
            wanted[near] = True
            take = wanted[owner]
            common = np.bincount(owner[take], np.isin(flat[take], sets[at]), len(sets))[near]
            hit = near[common >= similarity * (size[near] + size[at] - common) - 1e-9]
            edges += [(at, int(j)) for j in hit]
            queue += hit.tolist()
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    return edges


def _verify(similarity: float):
    """mapInArrow function over rows sorted by (band, bi, bj): exact links of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for b in batches:
            for key, a, c, one, two, packed in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (key, a, c) != now:
                    yield from done(ids, sets)
                    now, ids, sets = (key, a, c), [], []
                ids.append((one, two))
                sets.append(packed)
        yield from done(ids, sets)

    def done(ids: list, sets: list) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            found = _similar([np.unique(np.frombuffer(p, np.uint64)) for p in sets], similarity)
            pairs = [(ids[i], ids[j]) for i, j in found]
            if pairs:
                kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
                ends = [[{"h1": p[k][0], "h2": p[k][1]} for p in pairs] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(e, kind) for e in ends], names=["a", "b"])

    return run


def band_lists(lines: DataFrame) -> DataFrame:
    """(h1, h2, band, n): lines that share a band with another of the n there. ``lines`` has
    a row per distinct line with h1, h2 and bands. A table made by materialize()."""
    postings = lines.select("h1", "h2", F.explode("bands").alias("band"))
    sizes = materialize(postings.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "paragraph-sizes")
    met = materialize(postings.join(sizes, "band"), "paragraph-lists")
    discard(sizes)
    return met


def line_links(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, list_cap: int = LIST_CAP) -> DataFrame:
    """(a, b): verified links between different lines, as structs of the line's hashes.
    ``met``: band_lists(); ``sets``: (h1, h2, shingles) with a row for each line of them."""
    dealt = met.withColumn("blocks", F.ceil(F.col("n") / list_cap))
    dealt = dealt.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("h1", "h2"), "blocks")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "h1", "h2")
    full = dealt.join(sets, ["h1", "h2"]).select("band", "bi", "bj", "h1", "h2", "shingles")
    ready = full.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    kind = "struct<h1:bigint,h2:bigint>"
    return ready.mapInArrow(_verify(similarity), f"a {kind}, b {kind}")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, text) of the rows with an id. t is a hash of the text: it and the id name
    a row, so that rows which repeat an id with another text aren't taken for each other."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, t, start, end, first_doc_id, first_start, removed, line): word ranges
    [start, end) of documents that occur elsewhere too, with an earlier occurrence; removed
    is false where a range is itself the earlier one. line: a paragraph of kind (a), else a
    match of kind (b), of any length; see duplicates() for what counts.

    t is a hash of the text, as rows may repeat an id. Null and empty texts have no
    paragraphs; rows with a null id are left out, as a span must name its document. Equal
    rows count as one document. A paragraph that a text repeats itself is reported, too;
    matches of a text with itself only where the two places are PASSAGE + REACH words apart.
    An empty table gives an empty result. Other columns are ignored. A table made by
    materialize()."""
    rows = keyed(docs, id_col, text_col)
    units = materialize(rows.mapInArrow(_units, UNITS), "paragraphs")
    lines = units.filter("bands is not null")

    anchors = units.filter("bands is null").select("doc_id", "t", F.col("h1").alias("h"), F.col("start").alias("n"))
    repeated = materialize(anchors.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    wanted = anchors.drop("n").join(repeated.hint("merge"), "h").select("doc_id", "t", F.struct("h", (F.col("n") > list_cap).alias("hot")).alias("a"))

    first = F.min(F.struct("doc_id", "t", "start", "end")).alias("first")
    classes = lines.groupBy("h1", "h2").agg(first, F.count("*").alias("n"), F.min("bands").alias("bands"))
    classes = materialize(classes, "paragraph-classes")
    met = band_lists(classes)
    held = classes.join(met.select("h1", "h2").distinct().hint("merge"), ["h1", "h2"]).select("first.doc_id", "first.t", F.struct("first.start", "first.end", "h1", "h2").alias("l"))

    null = lambda other, c: F.lit(None).cast(other.schema[c].dataType).alias(c)
    both = wanted.select("doc_id", "t", "a", null(held, "l")).union(held.select("doc_id", "t", null(wanted, "a"), "l"))
    asked = both.groupBy("doc_id", "t").agg(F.collect_list("a").alias("anchors"), F.collect_list("l").alias("lines"))
    details = rows.join(asked.hint("merge"), ["doc_id", "t"]).select("doc_id", "t", "text", "anchors", "lines").mapInArrow(_details, _DETAILS)
    details = materialize(details, "paragraph-details")
    discard(repeated)

    matches = passage_matches(details, list_cap)
    p_doc, p_start, before = F.col("p_doc_id"), F.col("p_start"), F.when(F.col("side") == 0, F.col("length")).otherwise(0)
    size = ANCHOR + F.col("length")
    later = matches.select("doc_id", "t", (F.col("start") - before).alias("start"), size.alias("size"), p_doc.alias("first_doc_id"), (p_start - before).alias("first_start"), F.lit(True).alias("removed"))
    earlier = matches.select(p_doc.alias("doc_id"), F.col("p_t").alias("t"), (p_start - before).alias("start"), size.alias("size"), p_doc.alias("first_doc_id"), (p_start - before).alias("first_start"), F.lit(False).alias("removed"))
    # The places of a document bound its different rows, however often it is the earlier one.
    windows = later.union(earlier).distinct()
    windows = windows.select("doc_id", "t", "start", (F.col("start") + F.col("size")).alias("end"), "first_doc_id", "first_start", "removed", F.lit(False).alias("line"))

    sets = details.filter("side = 2").groupBy(F.col("g").alias("h1"), F.col("c").alias("h2")).agg(F.first("data").alias("shingles"))
    near = connected_components(line_links(met, sets, list_cap=list_cap), "a", "b")
    by_line = near.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component")
    joined = classes.join(by_line, ["h1", "h2"], "left").filter("component is not null or n > 1")
    joined = joined.select("h1", "h2", "first", F.coalesce("component", F.struct("h1", "h2")).alias("component"))
    joined = materialize(joined, "paragraph-joined")
    discard(classes, met, near)
    # Written for the joins, that they may split a hot component's or line's rows.
    firsts = materialize(joined.groupBy("component").agg(F.min("first").alias("first")), "paragraph-firsts")
    named = materialize(joined.select("h1", "h2", "component").join(firsts, "component").select("h1", "h2", "first"), "paragraph-named")
    spans = lines.select("doc_id", "t", "start", "end", "h1", "h2").join(named.hint("merge"), ["h1", "h2"])
    is_first = F.struct("doc_id", "t", "start") == F.struct("first.doc_id", "first.t", "first.start")
    spans = spans.select("doc_id", "t", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), (~is_first).alias("removed"), F.lit(True).alias("line"))
    out = materialize(spans.distinct().union(windows), "duplicate-spans")
    discard(units, details, matches, joined, firsts, named)
    return out


def _merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (owner, start, end) as sorted disjoint ones; what touches is joined."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Owners stand one behind the other, each on a stretch of its own.
    base = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.flatnonzero(np.r_[True, (base + start)[1:] > reach[:-1]])
    last = np.r_[new[1:] - 1, len(owner) - 1]
    return owner[new], start[new], (reach - base)[last]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, t, found) to one row of merged spans each; see duplicates()."""

    def lists(n: int, owner: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)

    def spans(n: int, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
        pairs = [pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        return lists(n, owner, pa.StructArray.from_arrays(pairs, names=["start", "end"]))

    for b in batches:
        n, found = b.num_rows, b.column(2)
        owner = np.repeat(np.arange(n), pc.list_value_length(found).to_numpy())
        flat = found.flatten()
        start, end, gone, line, first = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        start, end = start.astype(np.int64), end.astype(np.int64)

        def some(which: np.ndarray) -> tuple[tuple, tuple]:
            """The passages that are long enough, and they with the lines, merged."""
            own = ~line & which  # noqa: B023
            passages = _merge(owner[own], start[own], end[own])  # noqa: B023
            long = passages[2] - passages[1] >= PASSAGE
            passages = tuple(x[long] for x in passages)
            lines = [x[line & which] for x in (owner, start, end)]  # noqa: B023
            return passages, _merge(*(np.r_[x, y] for x, y in zip(passages, lines, strict=True)))

        passages, everything = some(np.ones(len(owner), bool))
        _, removed = some(gone)
        inside = line.copy()
        if len(passages[0]):
            wide = int(end.max()) + 2
            at = np.maximum(0, np.searchsorted(passages[0] * wide + passages[1], owner * wide + start, "right") - 1)
            inside |= (passages[0][at] == owner) & (passages[1][at] <= start) & (end <= passages[2][at])
        order = np.lexsort((first[inside], owner[inside]))
        o, f = owner[inside][order], first[inside][order]
        new = np.r_[True, (o[1:] != o[:-1]) | (f[1:] != f[:-1])][: len(o)]
        many = np.bincount(removed[0], removed[2] - removed[1], n).astype(np.int64)
        columns = [b.column(0), b.column(1), spans(n, *everything), spans(n, *removed), pa.array(many), lists(n, o[new], pa.array(f[new], pa.int64()))]
        out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "spans", "removed_spans", "n_removed_words", "first_doc_ids"])
        yield out.filter(pc.greater(pc.list_value_length(out.column(2)), 0))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """One row per different document with a repeated paragraph: doc_id, t (a hash of its
    text), spans and removed_spans (disjoint word ranges: of all its repeated paragraphs, and
    of those to remove), n_removed_words and first_doc_ids (the documents with the first
    occurrences). Matches count where together they cover PASSAGE words or more. Nulls,
    empty texts, repeated ids and rows: see duplicate_spans(). A table made by
    materialize()."""
    found = duplicate_spans(docs, id_col, text_col, list_cap)
    # The different spans of a document are bounded by its text.
    by_doc = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "end", "removed", "line", "first_doc_id")).alias("found"))
    span = "array<struct<start:int,end:int>>"
    kind = f"doc_id long, t long, spans {span}, removed_spans {span}, n_removed_words long, first_doc_ids array<long>"
    out = materialize(by_doc.mapInArrow(_by_document, kind), "duplicates")
    discard(found)
    return out


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the words of the spans and the white space behind them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for s in spans:
        out.append(text[done : at[s["start"]]])
        done = at[s["end"]]
    return b"".join([*out, text[done:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the spans to remove. Columns stay; n_chars, if there is one, counts
    the new text. A document that loses all its words goes; others stay, those without
    repeated paragraphs unchanged. Rows that repeat an id have their own spans each; equal
    rows have the same. Rows with a null id or text stay as they are."""
    found = duplicates(docs, id_col, text_col).filter("n_removed_words > 0")
    spans = found.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), F.col("removed_spans").alias("__spans"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"))
    ready = rows.join(spans.hint("merge"), (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__t")), "left").select("row", "text", "__spans")
    kind = ready.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2).to_pylist()
            texts = b.column(1).to_pylist()
            new = [t if s is None or t is None else cut_words(t.encode(), s).decode() for t, s in zip(texts, spans, strict=True)]
            gone = [s is not None and n is not None and not n.encode().split() for n, s in zip(new, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(gone)], names=["row", "text", "gone"])

    cut = ready.mapInArrow(run, f"row {kind}, text string, gone boolean").filter("not gone")
    columns = [
        F.col("text").alias(c) if c == text_col else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return cut.select(*columns)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
