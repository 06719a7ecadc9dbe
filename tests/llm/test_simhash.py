from itertools import combinations

import numpy as np
from lodestone.llm import simhash as S
from lodestone.llm.components import connected_components


def brute(rows):
    """doc_id -> (fingerprint, component) by all pairs."""
    fp = [S.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_triples_cover_every_four_positions():
    assert len(S.TRIPLES) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in S.TRIPLES)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (5, "A b c d e"), (6, "w " * 30000)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, fp long, component_id int")
    got = sorted(tuple(r) for r in S.near_duplicates(docs).collect())
    assert got == brute(rows)
    assert [g[1] for g in got[:3]] == ["0" * 16] * 3
    assert S.near_duplicates(docs.limit(0)).count() == 0
    # The equal rows of id 4 are copies of each other: one stays.
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1, 2, 3, 4, 5, 6]
    assert S.keep_one(docs).columns == docs.columns and S.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_of_an_id_apart(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(3, line), (9, line), (9, "another text that copies nothing"), (4, line + " x"), (4, line + " x"), (None, line), (None, "of no id"), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    assert S.fingerprint((line + " x").encode()) ^ S.fingerprint(line.encode()) != 0
    left = sorted(((r.doc_id or 0), r.text) for r in S.keep_one(docs).collect())
    near = bin(S.fingerprint((line + " x").encode()) ^ S.fingerprint(line.encode())).count("1") <= 4
    want = [(0, "of no id"), (3, line), (5, ""), (5, " "), (9, "another text that copies nothing")] + ([] if near else [(4, line + " x")])
    assert left == sorted(want)


def test_a_fingerprint_near_zero_is_no_empty_text(spark, monkeypatch):
    real = S.fingerprint
    monkeypatch.setattr(S, "fingerprint", lambda t: {b"zero": 0, b"near": 3, b"near too": 5}.get(t, real(t)))
    rows = [(1, ""), (2, None), (3, "near"), (4, "zero"), (5, "near too"), (6, "far from it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fake = S.fingerprints

    def local(docs, id_col="doc_id", text_col="text"):
        keys = {(r.doc_id, r.text): r.t for r in fake(docs).select("doc_id", "t").join(docs, "doc_id").collect()}
        got = [(r.doc_id, keys[r.doc_id, r.text], S.fingerprint((r.text or "").encode()), not (r.text or "").strip()) for r in docs.collect()]
        return spark.createDataFrame([(d, t, f - 2**64 if f >= 2**63 else f, w) for d, t, f, w in got], "doc_id long, t long, fp long, wordless boolean")

    monkeypatch.setattr(S, "fingerprints", local)
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1, 2, 3, 6]


def test_hot_list_in_blocks_keeps_every_link(spark):
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(300)]
    fps = np.unique(np.array([base ^ f for f in flips] + list(rng.integers(0, 2**63, 300, dtype=np.uint64)), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = S.links(df, list_cap=40)
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if np.bitwise_count(a ^ b) <= 4:
            x, y = find(int(a.view(np.int64))), find(int(b.view(np.int64)))
            root[max(x, y)] = min(x, y)
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 1), (5, 5)], "x long, y long")
    got = connected_components(edges, "x", "y").collect()
    assert len(got) == 201 and {r.component for r in got} == {0}
