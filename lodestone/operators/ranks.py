"""Order statistics without a task that sees all rows.

Values are dealt into ranges that driver-side edges bound; a table with a row for each range
says what lies before it, and windows run within a range only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
#: Bits of the hash that orders rows, and how many hexadecimal digits give them.
HASH_BITS, HASH_DIGITS = 60, 15


def _pick(x: Column, edges: list[float], lo: int, hi: int) -> Column:
    """How many of the ascending edges lie at or below x, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < edges[mid], _pick(x, edges, lo, mid)).otherwise(_pick(x, edges, mid + 1, hi))


def picked(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges lie at or below x."""
    return _pick(x, edges, 0, len(edges))


def ranged(df: DataFrame, column: str, name: str = "__range") -> DataFrame:
    """``df`` with the number of the range of a column, ascending with its values; at most
    ``RANGES`` of about equally many rows, one if there are few shuffle partitions."""
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES)
    x = F.col(column).cast("double")
    edges = sorted(set(df.select(x.alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    return df.withColumn(name, _pick(x, edges, 0, len(edges)))


def running(by: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``by``, a row for each value of ``order``, with ``run_x`` (the sum of x up to and with the
    row) and ``all_x`` (of all rows) for each x of ``sums``."""
    dealt = ranged(by, order)
    end, whole = F.col("__range").desc() if descending else F.col("__range").asc(), Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy(end).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(s).alias(s) for s in sums])  # at most RANGES rows
    starts = totals.select("__range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__before_{s}") for s in sums], *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums])
    down = Window.partitionBy("__range").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(starts), "__range")
    return joined.select(*by.columns, *[(F.col(f"__before_{s}") + F.sum(s).over(down)).alias(f"run_{s}") for s in sums], *[f"all_{s}" for s in sums])


def seeded_hash(id_col: str, seed: int = 0) -> Column:
    """A number of ``HASH_BITS`` bits: the leading digits of the MD5 of "seed:id", which any SQL engine computes."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, HASH_DIGITS), 16, 10).cast("long")


def numbered(df: DataFrame, id_col: str, seed: int = 0, rank: str = "__rank", total: str = "__total") -> DataFrame:
    """``df`` with gapless numbers from 0 in the order of a seeded hash of the ids, and the number
    of rows. Ids are unique; they alone decide, however the rows are dealt. The hash is uniform,
    so that its leading bits are the ranges."""
    bits = min(int(math.log2(RANGES)), max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    dealt = df.withColumn("__hash", seeded_hash(id_col, seed)).withColumn("__range", F.shiftright("__hash", HASH_BITS - bits))
    one = Window.partitionBy(F.lit(1))
    before = one.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # at most RANGES rows
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(one).alias(total))
    within = F.row_number().over(Window.partitionBy("__range").orderBy("__hash", id_col)) - 1
    return dealt.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__before") + within).alias(rank), total)


def quantiles(df: DataFrame, columns: list[str], shares: list[float], interpolate: bool = False, error: float = 1e-3, rounds: int = 4, enough: int = 1_000_000) -> dict[str, list[float | None]]:
    """Exact quantiles of each column: the smallest value at or below which a share of the values
    lies, or with ``interpolate`` that between the values at both sides of share * (n - 1). Nulls
    and NaN aren't values; a column without values gives None.

    While a bracket of a wanted place holds over ``enough`` rows, a mergeable sketch narrows it and
    one scan counts what lies below and within; only rows in the brackets are then grouped by value
    and counted up."""
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    clean = df.select(*[x[c].alias(f"c{k}") for k, c in enumerate(columns)])
    sizes = clean.agg(*[F.count(f"c{k}").alias(f"n{k}") for k in range(len(columns))]).first()
    places = {}  # (column, place from 1) -> None, then its value
    for k in range(len(columns)):
        for s in shares if sizes[k] else []:
            at = s * (sizes[k] - 1) if interpolate else max(1, math.ceil(s * sizes[k] - 1e-9)) - 1
            for place in {math.floor(at), math.ceil(at)}:
                places[k, min(place, sizes[k] - 1) + 1] = None
    brackets = {key: (-math.inf, math.inf, 0, sizes[key[0]]) for key in places}  # low, high, rows below, rows within
    for _ in range(rounds):
        wide = [key for key, (lo, hi, _, n) in brackets.items() if n > enough and lo < hi]
        if not wide:
            break
        asked = clean.select(*[F.when(F.col(f"c{k}").between(*brackets[k, p][:2]), F.col(f"c{k}")).alias(f"b{i}") for i, (k, p) in enumerate(wide)])
        grid = sorted({min(max((p - brackets[k, p][2]) / brackets[k, p][3] + g, 0.0), 1.0) for k, p in wide for g in (-2 * error, 2 * error)})
        sketched = asked.approxQuantile(asked.columns, grid, error)
        tried = {}
        for key, got in zip(wide, sketched):
            share = (key[1] - brackets[key][2]) / brackets[key][3]
            lo, hi = (got[grid.index(min(max(share + g, 0.0), 1.0))] for g in (-2 * error, 2 * error))
            tried[key] = lo, hi
        terms = [f for i, (key, (lo, hi)) in enumerate(tried.items()) for f in (F.count_if(F.col(f"c{key[0]}") < lo).alias(f"l{i}"), F.count_if(F.col(f"c{key[0]}").between(lo, hi)).alias(f"w{i}"))]
        row = clean.agg(*terms).first()
        for i, (key, (lo, hi)) in enumerate(tried.items()):
            if row[f"l{i}"] < key[1] <= row[f"l{i}"] + row[f"w{i}"]:
                brackets[key] = lo, hi, row[f"l{i}"], row[f"w{i}"]
    shared: dict[tuple, list[int]] = {}  # (column, low, high, rows below) -> the places counted from its first row
    for (k, p), (lo, hi, below, _) in brackets.items():
        shared.setdefault((k, lo, hi, below), []).append(p - below)
    if shared:
        inside = F.array(*[F.when(F.col(f"c{k}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.col(f"c{k}").alias("x"))) for i, (k, lo, hi, _) in enumerate(shared)])
        found = clean.select(F.inline(F.array_compact(inside))).groupBy("i", "x").agg(F.count("*").alias("n"))
        up = Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        wanted = F.element_at(F.lit(list(shared.values())), F.col("i") + 1)
        hit = found.select("i", "x", "n", F.sum("n").over(up).alias("run"), wanted.alias("wanted")).filter(F.exists("wanted", lambda p: (F.col("run") >= p) & (F.col("run") - F.col("n") < p)))
        bounds = list(shared)
        for r in hit.collect():  # at most a row for each place
            k, _, _, below = bounds[r.i]
            places.update({(k, p + below): r.x for p in r.wanted if r.run - r.n < p <= r.run})
    out = {}
    for k, c in enumerate(columns):
        out[c] = []
        for s in shares:
            if not sizes[k]:
                out[c].append(None)
                continue
            at = s * (sizes[k] - 1) if interpolate else max(1, math.ceil(s * sizes[k] - 1e-9)) - 1
            lo, hi = places[k, min(math.floor(at), sizes[k] - 1) + 1], places[k, min(math.ceil(at), sizes[k] - 1) + 1]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The smallest of the most frequent values of each column, from counts by value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("c"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("x")) for k, c in enumerate(columns)])
    counts = df.select(F.inline(pairs)).filter("x is not null").groupBy("c", "x").agg(F.count("*").alias("n"))
    best = {r.c: r.x for r in counts.groupBy("c").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("x")).collect()}
    return {c: best.get(k) for k, c in enumerate(columns)}
