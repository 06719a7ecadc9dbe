import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from lodestone.llm import packing as P


def whole(docs, rows, capacity=2048):
    """Every document's ids are there once, in order; sequences are gapless and fit."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    want = sorted(
        (d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
        for d, text in docs
        for ids in [[*t.encode(text or "", add_special_tokens=False).ids, 0]]
        for k, (s, n) in enumerate(P.cut(len(ids), capacity))
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    return len(by)


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.op9_packing(spark, "/root/testdata/sf0.01").collect()
    n = whole([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rows)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_edge_rows_and_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "SALT_ROWS", 3)
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "hello world " * 20000)] + [(9, "same text")] * 40
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, sequence_id int, length int")
    whole(docs, P.pack_documents(df, P.tokenizer_path()).collect())
    assert P.pack_documents(df.limit(0), P.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 3000)], "a int, length int"), ["a"])


def test_the_query_takes_special_strings_as_tokenizers_does(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = [(1, "a <|endoftext|> b"), (2, "plain <|endof"), (3, "<|endoftext|>" * 3000), (4, " " * 1_100_000 + "<|endoftext|>")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in docs}
    want = sorted((d, k, n, zlib.crc32(np.array(i[s : s + n], "<u4").tobytes())) for d, i in ids.items() for k, (s, n) in enumerate(P.cut(len(i), 2048)))
    assert 50256 in ids[1] and sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in P.op9_packing(spark, str(tmp_path)).collect()) == want


def test_very_long_white_space_is_encoded(spark):
    docs = [(1, "a" + " " * 1_100_000 + "b"), (2, "x\n" + "\n" * 1_100_000), (3, "a <|endoftext|> b" + "\t" * 1_100_000 + "c"), (4, "plain")]
    whole(docs, P.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), P.tokenizer_path()).collect())


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_demand_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = np.bincount(np.minimum(2048, rng.lognormal(6.5, 1, 20000).astype(int) + 1), minlength=2049)
    plan = P.make_plan(demand)
    held = np.zeros(2049, int)
    for config, n in plan:
        assert sum(config) <= 2048
        for length in config:
            held[length] += n
    assert (held == demand).all()
    bound = max(demand[1025:].sum(), -(-int((demand * np.arange(2049)).sum()) // 2048))
    assert sum(n for _, n in plan) <= 1.005 * bound + 1


@pytest.mark.parametrize("low, high, kinds", [(300, 1100, 40), (500, 800, 300)])
def test_plan_beats_best_fit_where_that_is_poor(low, high, kinds):
    rng = np.random.default_rng(5)
    demand = np.zeros(2049, int)
    demand[rng.integers(low, high, kinds)] = rng.integers(50, 5000, kinds)
    assert sum(n for _, n in P.make_plan(demand)) < sum(n for _, n in P.best_fit_decreasing(demand, 2048))
