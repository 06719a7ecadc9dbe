"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words are read in overlapping windows of WINDOW words, STRIDE apart, to its end.
Each word enters as a hashed word embedding beside a character layer over all its bytes:
the first ones by position, and the hashed runs of three bytes of the whole word; a GRU runs over the window in each direction, attention pools its states and
a logistic unit scores the window. A document's score is that of its highest window,
calibrated. Training is numpy on the driver, on a bounded sample of labelled documents:
only document labels are known, so toxic documents teach by their highest window (at first
by word and prefix log-odds of the training sample) and clean ones by their highest and by
random ones. Scoring runs inside the scan's tasks; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import utf8_rows
from .decontamination import words

WINDOW, STRIDE = 32, 16
BUCKETS, WORD_DIM = 1 << 14, 8
BYTES, RUNS, CHAR_DIM = 12, 1 << 13, 8
HIDDEN = 8
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 20_000
EPOCHS = 14
THRESHOLD = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Spelling:
    """The bytes of words as rows of the character table: ``head`` the first BYTES of each
    (byte 0: past the end), and ``tail`` the runs of three bytes, ``many`` of each word,
    which together weigh no more than BYTES bytes do."""

    head: np.ndarray
    tail: np.ndarray
    many: np.ndarray

    def __getitem__(self, rows: np.ndarray) -> Spelling:
        many = self.many[rows]
        first = (np.cumsum(self.many) - self.many)[rows]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return Spelling(self.head[rows], self.tail[at], many)

    def owner_weight(self) -> tuple[np.ndarray, np.ndarray]:
        weight = np.minimum(1, BYTES / np.maximum(1, self.many))
        return np.repeat(np.arange(len(self.many)), self.many), np.repeat(weight, self.many).astype(np.float32)


def encode(vocabulary: list[bytes]) -> tuple[np.ndarray, Spelling]:
    """Word buckets (from 1; 0 is no word) and the spelling of each whole word."""
    bucket = np.array([1 + xxhash.xxh32_intdigest(w) % (BUCKETS - 1) for w in vocabulary] or [0], np.int64)[: len(vocabulary)]
    raw = b"".join(w[:BYTES].ljust(BYTES, b"\0") for w in vocabulary)
    head = np.frombuffer(raw, np.uint8).reshape(-1, BYTES).astype(np.int64) + 256 * np.arange(BYTES)
    # Runs of three over all words with their edges marked; none goes over an edge.
    flat = np.frombuffer(b"\0" + b"\0".join(vocabulary) + b"\0", np.uint8).astype(np.int64)
    runs = BYTES * 256 + (flat[:-2] * 40503 + flat[1:-1] * 2654435761 + flat[2:] * 97 >> 3) % RUNS
    many = np.array([len(w) for w in vocabulary], np.int64)
    first = np.cumsum(many + 1) - many - 1
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return bucket, Spelling(head, runs[at], many)


def starts(n: int) -> range:
    """Starts of the windows of n words: they overlap and reach the last word."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class Network:
    def __init__(self, seed: int = 20):
        r = np.random.default_rng(seed)
        n = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "word": 0.1 * r.normal(size=(BUCKETS, WORD_DIM)).astype(np.float32),
            "char": 0.3 * r.normal(size=(BYTES * 256 + RUNS, CHAR_DIM)).astype(np.float32),
            "att": n(2 * HIDDEN, HIDDEN), "att_v": n(HIDDEN), "out": n(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"w{d}": n(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, bucket: np.ndarray, chars: Spelling, drop: np.ndarray | None = None) -> np.ndarray:
        total = self.p["char"][chars.head].sum(axis=1)
        if len(chars.tail):
            owner, weight = chars.owner_weight()
            np.add.at(total, owner, self.p["char"][chars.tail] * weight[:, None])
        word = self.p["word"][bucket]
        if drop is not None:
            word = word * drop[:, None]
        return np.concatenate([word, np.tanh(total)], axis=1)

    def _gru(self, d: str, projected: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, B, H) of one direction, in the order of time."""
        t_all, b = mask.shape
        u, h = self.p[f"u{d}"], np.zeros((b, HIDDEN), np.float32)
        out, saved = np.empty((t_all, b, HIDDEN), np.float32), [None] * t_all
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            x, hu = projected[t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved[t] = (h, hu, z, r, n)
            out[t] = h = new
        return out, saved

    def forward(self, projected: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Window logits from the input projections (T, B, 3H) of both directions."""
        (hf, sf), (hb, sb) = (self._gru(d, projected[d], mask, keep) for d in "fb")
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ self.p["att"])
        e = np.where(mask, a @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (e[:, :, None] * h).sum(axis=0)
        return pooled @ self.p["out"] + self.p["bias"], (h, a, e, pooled, sf, sb)

    def train_step(self, bucket: np.ndarray, chars: Spelling, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss. index: (T, B) into the encoded words."""
        x = self.inputs(bucket, chars, drop)
        projected = {d: (x @ self.p[f"w{d}"] + self.p[f"c{d}"])[index] for d in "fb"}
        logit, (h, a, e, pooled, sf, sb) = self.forward(projected, mask, True)
        g: dict[str, np.ndarray] = {}
        dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * self.p["out"]
        dh = e[:, :, None] * dpool
        de = (h * dpool).sum(axis=2)
        de = e * (de - (e * de).sum(axis=0))
        g["att_v"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att"] = np.einsum("tbi,tbj->ij", h, da, optimize=True)
        dh = dh + da @ self.p["att"].T
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            u = self.p[f"u{d}"]
            carry, gu, dproj = np.zeros_like(part[0]), np.zeros_like(u), np.empty_like(projected[d])
            t_all = len(mask)
            for t in range(t_all - 1, -1, -1) if d == "f" else range(t_all):
                h0, hu, z, r, n = saved[t]
                dnew = carry + part[t]
                live = mask[t][:, None]
                dn = np.where(live, dnew * (1 - z), 0) * (1 - n * n)
                dz = np.where(live, dnew * (h0 - n), 0) * z * (1 - z)
                dr = dn * hu[:, 2 * HIDDEN :] * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
                gu += h0.T @ dhu
                carry = np.where(live, dnew * z, dnew) + dhu @ u.T
            g[f"u{d}"] = gu
            flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(flat, index.ravel(), dproj.reshape(-1, 3 * HIDDEN))
            g[f"c{d}"], g[f"w{d}"] = flat.sum(axis=0), x.T @ flat
            dx += flat @ self.p[f"w{d}"].T
        gw = np.zeros_like(self.p["word"])
        np.add.at(gw, bucket, dx[:, :WORD_DIM] * drop[:, None])
        gc = np.zeros_like(self.p["char"])
        dc = dx[:, WORD_DIM:] * (1 - x[:, WORD_DIM:] ** 2)
        np.add.at(gc, chars.head.ravel(), np.repeat(dc, BYTES, axis=0))
        owner, weight = chars.owner_weight()
        np.add.at(gc, chars.tail, dc[owner] * weight[:, None])
        return g | {"word": gw, "char": gc}

    def scorer(self) -> Scorer:
        return Scorer(self)

    def score(self, top: np.ndarray) -> np.ndarray:
        scale, shift = self.calibration
        return _sigmoid(scale * top + shift)


@dataclass
class Scorer:
    """Highest window logits of texts; keeps the input projections of words it has met."""

    net: Network
    most: int = 200_000
    seen: dict = field(default_factory=dict)
    rows: dict = field(default_factory=dict)

    def _index(self, text: list[bytes]) -> np.ndarray:
        seen = self.seen
        return np.array([seen[w] if w in seen else seen.setdefault(w, len(seen)) for w in text], np.int64)

    def _project(self) -> None:
        have = len(self.rows["f"]) if self.rows else 0
        fresh = list(self.seen)[have:] if have < len(self.seen) else []
        if not fresh:
            return
        x = self.net.inputs(*encode(fresh))
        for d in "fb":
            new = (x @ self.net.p[f"w{d}"] + self.net.p[f"c{d}"]).astype(np.float32)
            self.rows[d] = np.concatenate([self.rows[d], new]) if have else new

    def top(self, texts: list[list[bytes]], detail: bool = False, batch: int = 4096):
        """The highest logit of each text, or with ``detail`` all window logits and the
        text of each window. A text without words is one empty window."""
        if len(self.seen) > self.most:
            self.seen, self.rows = {}, {}
        self._index([b""])
        texts = [self._index(t) for t in texts]
        self._project()
        owner, begin = [], []
        for k, t in enumerate(texts):
            s = starts(len(t))
            owner += [k] * len(s)
            begin += s
        owner, begin = np.array(owner), np.array(begin)
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        flat = np.concatenate([*texts, np.zeros(WINDOW, np.int64)])
        logits = np.empty(len(owner), np.float32)
        for k in range(0, len(owner), batch):
            o, b = owner[k : k + batch], begin[k : k + batch]
            place = b + np.arange(WINDOW)[:, None]
            mask = place < size[o]
            index = np.where(mask, flat[np.minimum(first[o] + place, len(flat) - 1)], 0)
            logits[k : k + batch] = self.net.forward({d: self.rows[d][index] for d in "fb"}, mask)[0]
        if detail:
            return logits, owner, begin
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, owner, logits)
        return best


def train(texts: list[list[bytes]], toxic: np.ndarray, seed: int = 20, epochs: int = EPOCHS) -> Network:
    """A network fitted to documents (lists of words) and their labels. Without documents
    of both labels it stays untrained and scores everything by the share of toxic ones."""
    net = Network(seed)
    toxic = toxic.astype(np.float32)
    if not len(texts) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(texts) else 0.5
        net.calibration = (0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
        return net
    # Texts without words are clean, and taught as such.
    texts, toxic = [*texts, *[[]] * 20], np.r_[toxic, np.zeros(20, np.float32)]
    rng = np.random.default_rng(seed)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys([b"", *(w for t in texts for w in t)]))}
    bucket, chars = encode(list(vocabulary))
    index = [np.array([vocabulary[w] for w in t], np.int64) for t in texts]
    odds = _log_odds(texts, toxic, list(vocabulary))
    windows = [np.array(list(starts(len(t)))) for t in texts]
    best = [s[int(np.argmax([odds[i[a : a + WINDOW]].max(initial=-9) for a in s]))] for s, i in zip(windows, index)]
    m, v, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    for epoch in range(epochs):
        if epoch in (epochs // 3, epochs // 2, 3 * epochs // 4):  # the network chooses from now on
            logits, owner, begin = net.scorer().top(texts, detail=True)
            order = np.lexsort((-logits, owner))
            best = begin[order][np.r_[True, owner[order][1:] != owner[order][:-1]]]
        pick = [(k, int(best[k]), toxic[k]) for k in range(len(texts))]
        pick += [(int(k), int(rng.choice(windows[k])), 0.0) for k in np.flatnonzero(toxic == 0)]
        order = rng.permutation(len(pick))
        for at in range(0, len(order), 256):
            part = [pick[k] for k in order[at : at + 256]]
            idx = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part)), bool)
            for j, (k, a, _) in enumerate(part):
                w = index[k][a : a + WINDOW]
                idx[: len(w), j], mask[: len(w), j] = w, True
            used, local = np.unique(idx, return_inverse=True)
            y = np.array([p[2] for p in part], np.float32)
            weight = np.where(y > 0, 2.0, 1.0).astype(np.float32)
            drop = (rng.random(len(used)) > 0.3).astype(np.float32)
            g = net.train_step(bucket[used], chars[used], local.reshape(idx.shape), mask, y, weight, drop)
            step += 1
            rate = 0.01 if epoch < 2 * epochs // 3 else 0.003
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.calibration = _platt(net.scorer().top(texts), toxic)
    return net


def _log_odds(texts: list[list[bytes]], toxic: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """For each word the larger of the log-odds of the word and of its first four bytes."""
    out = np.zeros(len(vocabulary))
    for form in (lambda w: w, lambda w: w[:4]):
        seen = [Counter(), Counter()]
        for t, y in zip(texts, toxic, strict=True):
            seen[int(y)].update({form(w) for w in t})
        n = [max(1.0, float((toxic == y).sum())) for y in (0, 1)]
        rate = lambda w: np.log((seen[1][w] + 0.5) / n[1]) - np.log((seen[0][w] + 0.5) / n[0]) if seen[1][w] >= 3 else 0.0  # noqa: B023, E731
        out = np.maximum(out, [rate(form(w)) for w in vocabulary])
    return out


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by damped Newton steps. The targets are drawn in
    a little, so that well separated training scores don't give an endless scale."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * x).sum() + 1e-2 * (a - 1), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def held_out(id_col: str):
    """The rows that never teach: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> Network:
    """Train on at most ``max_toxic`` and ``max_clean`` labelled documents, chosen by a hash
    of their id, that aren't held out and whose text has at most ``max_chars`` characters.
    ``labels`` has doc_id and toxic; an id that repeats there is toxic if any row says so,
    and of the texts that repeat an id the smallest teaches. Null ids, labels and texts
    don't teach."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out("doc_id")).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    usable = docs.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # Ids first: texts move only for the rows that teach. A hash cut at a share that the
    # counts give leaves little more than those rows for the ordering to choose from.
    ids = usable.select("doc_id").join(known, "doc_id").distinct()
    counts = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for is_toxic, most in ((True, max_toxic), (False, max_clean)):
        share = int(1e6 * min(1.0, 1.3 * most / max(1, counts.get(is_toxic, 0)) + 1e-6))
        part = ids.filter((F.col("toxic") == is_toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # At most max_toxic + max_clean ids, whatever the input.
    rows = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (-r.toxic, r.doc_id, r.text))
    return train([words(r.text.encode()) for r in rows], np.array([r.toxic for r in rows], float))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows) for each row. Null and empty texts
    are one empty window. Only the text reaches the network; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in batches:
            best, counts, group, size = [], [], [], 0
            for t in map(words, utf8_rows(b.column(1))):
                group.append(t)
                counts.append(len(starts(len(t))))
                size += len(t)
                if size > 100_000:
                    best.append(scorer.top(group))
                    group, size = [], 0
            if group:
                best.append(scorer.top(group))
            got = sent.value.score(np.concatenate(best).astype(np.float64)) if best else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array(counts, pa.int64())], names=["doc_id", "score", "n_windows"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double, n_windows long")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("n_windows")
