import zlib
from collections import defaultdict

import numpy as np
import pytest
from lodestone.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 24, 100, 1023, 4097, 65536])
def test_permutation_and_its_inverse(n):
    p = S.Feistel(n, 7)
    place = p.place(np.arange(n))
    assert sorted(place) == list(range(n)) and (p.row(place) == np.arange(n)).all()
    assert n < 100 or (place != S.Feistel(n, 8).place(np.arange(n))).any()


def check(rows, docs, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots[k]) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(n) - min(n) <= 1
    want = sorted((d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = S.op8_sharding(spark, "/root/testdata/sf0.01").collect()
    check(rows, docs, 24)
    place = S.Feistel(len(docs)).place(np.arange(len(docs)))
    by_id = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert all(by_id[d] == (place[k] % 24, place[k] // 24) for k, d in enumerate(sorted(by_id)))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_edge_rows(spark):
    docs = [(3, None), (3, ""), (1, "é"), (1, "é"), (None, "x"), (2, "long " * 20000)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, shard int, slot int, size int")
    check(S.shard_documents(df, shards=4).collect(), docs, 4)
    assert S.shard_documents(df.limit(0)).count() == 0
