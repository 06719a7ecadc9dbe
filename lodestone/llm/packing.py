"""Best-fit packing by a configuration linear program over the length histogram.

The histogram has at most ``capacity`` rows however many pieces there are, so the plan is
made on the driver in bounded memory: a configuration (a multiset of lengths that fits in
a sequence) is a column of a covering program; multiplicative weights keep a price on
each length, an unbounded-knapsack dynamic program finds the columns of best price, and
over-covered lengths get cheaper. The fractional solution is rounded by taking columns
from the largest value on while the demand allows; what is left is packed best-fit
decreasing, again by counts. Pieces get their place by their rank within their length:
ranks come from salted windows (a hot length is split over many tasks) and a searched
table of rank intervals, whose size doesn't depend on the number of pieces.
"""

from __future__ import annotations

import base64
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

CAPACITY = 2048
EOS = 0
SALT_ROWS = 1_000
ITERATIONS = 60
TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoder(path: str, specials: bool = False):
    """text -> ids as an array, for a tokenizer file. A .tiktoken file has the ranks of the
    same vocabulary as its .json file and gives the same ids about five times as fast
    (tests hold one against the other). Strings of special tokens are ordinary text, or with
    ``specials`` the tokens that the .json file has for them. Texts with such strings, then,
    and texts whose split overruns the stack of tiktoken's regex (a run of about a million
    white-space characters) are encoded from the .json file."""
    if path.endswith(".tiktoken"):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        other = path.removesuffix(".tiktoken") + ".json"
        strings = _special_strings(other) if specials else ()

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in strings):
                return _encoder(other, specials)(text)
            try:
                return e.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                return _encoder(other, specials)(text)

        return encode
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def _special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens") or [])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full pieces behind a first
    one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text", specials: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the pieces of each whole text's token ids and
    a closing ``eos``; ids are little-endian unsigned 32-bit integers. ``tokenizer`` is a
    file that every executor has. A null or empty text has the one token ``eos``. With
    ``specials`` strings of special tokens in a text are those tokens, else ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, specials)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for k in range(b.num_rows):
                ids = np.append(encode(b.column(1)[k].as_py() or ""), eos).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    values = (b.column(0)[k].as_py(), piece, start, length, ids[start : start + length].tobytes())
                    for out, x in zip(rows, values, strict=True):
                        out.append(x)
                if len(rows[0]) >= 4096 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)
                    rows = [[], [], [], [], []]

    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def price_knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity, with ``price[l]`` for an item of length l
    (-inf: no such item) and no bound on copies, and the item to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1]
        k = int(value.argmax())
        if value[k] > 0:
            best[room], take[room] = value[k], k + 1
    return best, take


def fractional_plan(demand: np.ndarray, iterations: int = ITERATIONS, slack: float = 0.02) -> dict[tuple[int, ...], float]:
    """Configurations and their fractional numbers, by multiplicative weights. demand[l]:
    items of length l; a configuration is its lengths, longest first."""
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return {}
    weight = np.full(capacity + 1, -np.inf)
    weight[lengths] = lengths / capacity
    columns: dict[tuple[int, ...], float] = defaultdict(float)
    for t in range(iterations):
        best, take = price_knapsack(weight, capacity)
        value = weight[lengths] + best[capacity - lengths]
        near = lengths[value >= (1 - slack) * best[capacity]]
        parts, room = [near], capacity - near
        while True:
            nxt = take[room]
            if not nxt.any():
                break
            parts.append(nxt)
            room = room - nxt
        config = -np.sort(-np.stack(parts, axis=1), axis=1)
        # Each column stands for the items of the length that it was found for.
        amount = demand[near] / np.maximum(1, (config == near[:, None]).sum(axis=1))
        covered = np.bincount(config.ravel(), np.repeat(amount, config.shape[1]), capacity + 1)
        for row, x in zip(config.tolist(), amount.tolist(), strict=True):
            while row[-1] == 0:
                row.pop()
            columns[tuple(row)] += x / iterations
        rate = np.clip(covered[lengths] / demand[lengths], 0, 4)
        weight[lengths] *= np.exp(-0.5 / np.sqrt(t + 1) * (rate - 1) * 0.2)
        weight[lengths] /= price_bound(weight, lengths, capacity)
    return columns


def price_bound(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """A scale that keeps prices near one a sequence."""
    return float(np.max(weight[lengths] * (capacity // lengths))) or 1.0


def round_plan(demand: np.ndarray, columns: dict[tuple[int, ...], float], rounds: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations that hold exactly the demand. Columns are rounded
    down and the program is solved again for what is left, a few times; best-fit decreasing
    takes the rest. Of doing this with all columns, with those that fill a sequence to the
    brim and with one round the plan with the fewest sequences counts."""
    capacity = len(demand) - 1
    plans = []
    for full in (False, True):
        left, plan, now = demand.astype(np.int64), [], columns
        for _ in range(rounds):
            taken = _round_down(left, {c: x for c, x in now.items() if not full or sum(c) == capacity})
            plan += taken
            for config, n in taken:
                np.subtract.at(left, list(config), n)
            plans.append(plan + best_fit_decreasing(left, capacity))
            if not taken or not left.any():
                break
            now = fractional_plan(left)
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _round_down(demand: np.ndarray, columns: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    left = demand.tolist()
    plan: list[tuple[tuple[int, ...], int]] = []
    for config, x in sorted(columns.items(), key=lambda c: (-sum(c[0]), -c[1], c[0])):
        counts: dict[int, int] = defaultdict(int)
        for length in config:
            counts[length] += 1
        n = min(int(x), *(left[length] // k for length, k in counts.items()))
        if n > 0:
            plan.append((config, n))
            for length, k in counts.items():
                left[length] -= n * k
    return plan


def best_fit_decreasing(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: equal open sequences are one entry."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in range(capacity, 0, -1):
        n = int(demand[length])
        rooms = sorted(r for r in open_by_room if r >= length and open_by_room[r])
        while n and rooms:
            room = rooms[0]
            config, have = next(iter(open_by_room[room].items()))
            used = min(n, have)
            n -= used
            open_by_room[room][config] -= used
            if not open_by_room[room][config]:
                del open_by_room[room][config]
            if not open_by_room[room]:
                rooms.pop(0)
            open_by_room[room - length][(*config, length)] += used
            if room - length >= length and room - length not in rooms:
                rooms = sorted([*rooms, room - length])
        each = capacity // length
        if n >= each:
            open_by_room[capacity - each * length][(length,) * each] += n // each
        if n % each:
            open_by_room[capacity - n % each * length][(length,) * (n % each)] += 1
    return [(c, n) for by_config in open_by_room.values() for c, n in by_config.items()]


def intervals(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in the configuration, first sequence, offset of the
    first copy), sorted by length and first rank."""
    rows, used, base = [], defaultdict(int), 0
    for config, n in plan:
        offset = 0
        k = 0
        while k < len(config):
            copies = config.count(config[k])
            rows.append((config[k], used[config[k]], copies, base, offset))
            used[config[k]] += n * copies
            offset += config[k] * copies
            k += copies
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def make_plan(demand: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    return round_plan(demand, fractional_plan(demand))


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: pieces of a sequence follow each other from 0
    without gaps and fit in ``capacity``. ``pieces`` must read the same rows each time (a
    written table), as it is read twice. ``keys`` give the order within a length; pieces
    that tie in them are placed in any order. Lengths must lie in 1..capacity. Columns
    named sequence_id or offset are replaced; an empty table gives an empty result."""
    spark = pieces.sparkSession
    hist = pieces.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n")).collect()
    demand = np.zeros(capacity + 1, np.int64)
    for r in hist:
        if r.length is None or not 1 <= r.length <= capacity:
            raise ValueError(f"a piece of length {r.length} doesn't fit")
        demand[r.length] = r.n
    table = spark.sparkContext.broadcast(intervals(make_plan(demand)))
    salts = F.element_at(F.lit((demand // SALT_ROWS + 1).tolist()), F.col("__length").cast("int") + 1)

    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = F.xxhash64(*keys)
    rows = pieces.select(F.struct(*own).alias("__row"), F.col(length_col).alias("__length"), F.struct(order, *keys).alias("__order"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__order"), salts))
    counts = rows.groupBy("__length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__length", "__salt").orderBy("__order"))
    ranked = rows.withColumn("__in", within - 1).join(firsts, ["__length", "__salt"])
    ranked = ranked.select("__row", "__length", (F.col("__first") + F.col("__in")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        starts = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            _, first, copies, base, offset = t[np.searchsorted(starts, (length << 44) + rank, "right") - 1].T
            by, copy = np.divmod(rank - first, copies)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base + by), pa.array(offset + copy * length)], names=["row", "sequence_id", "offset"])

    kind = rows.schema["__row"].dataType.simpleString()
    return ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, specials: bool = False) -> DataFrame:
    """Digest rows of the packed ``docs``: per piece its document, place and the CRC-32 of
    its ids. A null or empty text is one piece of one token; rows with a null or repeated id
    are documents of their own; an empty table gives an empty result; other columns are
    ignored."""
    pieces = token_pieces(docs, tokenizer, specials=specials).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"), ["doc_id", "piece"])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), specials=True)
