from lodestone.llm import decontamination as D

from .util import against_sql


def brute(text, items, window=10):
    w = D.words((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        b = D.words((t or "").encode())
        n = min(window, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), sorted(hit), sorted(found)


def test_sql(spark):
    against_sql(spark, D.op3_decontamination, D.OP3_SQL)


BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Item"), (3, "zap"), (4, None), (5, ""), (None, "null item here"), (2, "also short")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten eleven Twelve! y"),
    (1, "x one two three four five six seven eight nine ten eleven Twelve! y"),
    (2, None),
    (3, ""),
    (4, "short, ITEM zap zap"),
    (5, "also short item null item"),
    (6, "null item here " * 20000),
    (None, "one two three four five six seven eight nine"),
    (7, "eté zapé zap"),
]


def test_blocks_shards_and_edge_rows(spark):
    docs = spark.createDataFrame([(*r, 5, "z") for r in DOCS], "doc_id long, text string, n_words int, hit_spans string")
    bench = spark.createDataFrame([(*r, 0) for r in BENCH], "item_id long, text string, doc_id int")
    items = [("" if i is None else i, t) for i, t in BENCH]
    for kw in ({}, {"block_bytes": 30, "shard_words": 7}):
        got = D.annotate(docs, bench, ["doc_id"], **kw).collect()
        flat = sorted((r.row.doc_id or 0, r.n_words, [p for s in r.hit_spans for p in range(s.start, s.end)], sorted(r.item_ids)) for r in got)
        assert flat == sorted((d or 0, *brute(t, items)) for d, t in DOCS)
    one = {r.row.doc_id: r.longest_match for r in got}
    assert one[1] == 12 and one[4] == 2 and one[2] == 0
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3]
    assert D.annotate(docs, bench.limit(0), ["doc_id"]).filter("size(hit_spans) > 0").count() == 0
    assert D.annotate(docs.limit(0), bench, ["doc_id"]).count() == 0


def longest(text, items):
    """The longest run of words that a document shares with an item."""
    w, most = D.words((text or "").encode()), 0
    for _, t in items:
        b = D.words((t or "").encode())
        for i in range(len(w)):
            for j in range(len(b)):
                n = 0
                while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                    n += 1
                most = max(most, n if n > 1 or len(b) == 1 else 0)
    return most


def test_longest_matches_and_their_places_depend_on_no_shard(spark):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"a {twelve}"), (2, f"b c {twelve} d"), (3, "three four five six seven eight nine ten eleven twelve"), (4, "ten eleven"), (5, twelve + " " + twelve)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, twelve), (2, "seven eight nine ten zap")], "item_id long, text string")
    items = [(1, twelve), (2, "seven eight nine ten zap")]
    for kw in ({}, {"shard_words": 3}, {"block_bytes": 30}, {"least_match": 2}):
        got = {r.row.doc_id: r for r in D.annotate(docs, bench, ["doc_id"], **kw).collect()}
        assert {d: r.longest_match for d, r in got.items()} == {d: longest(t, items) for d, t in rows}
        places = {d: [(m.start, m.end) for m in r.matches if m.end - m.start >= 10] for d, r in got.items()}
        assert places == {1: [(1, 13)], 2: [(2, 14)], 3: [(0, 10)], 4: [], 5: [(0, 12), (12, 24)]}
        assert got[3].matches[0].item_id == "1" and got[3].matches[0].item_start == 2
