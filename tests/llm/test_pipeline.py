from collections import defaultdict

import corpus_pipeline as C
from lodestone.llm import simhash
from lodestone.llm._common import materialize

from .test_decontamination import brute as windows
from .test_packing import whole
from .test_simhash import brute as components

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema.names
    good = materialize(C.quality(spark, docs, SF), "t")
    assert good.columns == schema and 0 < good.count() < docs.count()
    one = materialize(C.near_duplicates(spark, good, SF), "t")
    want = {d for d, _, c in components(rows(good)) if d == c}
    assert one.columns == schema and {d for d, _ in rows(one)} == want
    cut = materialize(C.repeated_passages(spark, one, SF), "t")
    assert cut.columns == schema and {d for d, _ in rows(cut)} <= want
    assert C.substring_dedup.duplicates(cut).filter("n_removed_words > 0").count() <= 1
    clean = materialize(C.benchmark_leaks(spark, cut, SF), "t")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == schema and {d for d, _ in rows(clean)} == {d for d, t in rows(cut) if not windows(t, bench)[1]}
    whole(rows(clean), C.pack(spark, clean, SF).collect())


def test_run_equals_the_stages_one_by_one(spark):
    got = defaultdict(set)
    for r in C.run(spark, SF).collect():
        got[r.doc_id].add((r.piece, r.ids_crc32))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
    want = defaultdict(set)
    for r in docs.collect():
        want[r.doc_id].add((r.piece, r.ids_crc32))
    assert got == want and simhash.BITS == 4


def test_edge_rows(spark, tmp_path):
    words = lambda k, n: " ".join(f"the {c}word of" for c in (f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for i in range(n)))
    long = "\n".join(words(k, 200) for k in range(60, 80))
    texts = [(3, words(1, 30)), (9, words(1, 30)), (9, words(2, 30)), (9, words(3, 30)), (4, words(4, 30)), (4, words(4, 30)), (None, words(5, 30)), (1, None), (2, ""), (5, " \n"), (6, long), (7, "few words")]
    bench = [(1, " ".join(words(3, 30).split()[5:20])), (2, None), (3, "")]
    rows = [(d, t, None if t is None else len(t), "x", 1, 2) for d, t in texts]
    for name, data, schema in (("documents", rows, "doc_id long, text string, n_chars long, row string, t int, start int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in C.STAGES[:4]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "n_chars", "row", "t", "start"]
        kept.append(sorted((r.doc_id or 0, r.text) for r in docs.collect()))
    assert kept[0] == sorted((d or 0, t) for d, t in texts if t and len(t) > 20)
    assert kept[1] == kept[2] == sorted([(3, words(1, 30)), (9, words(2, 30)), (9, words(3, 30)), (4, words(4, 30)), (0, words(5, 30)), (6, long)])
    assert kept[3] == [x for x in kept[2] if x[1] != words(3, 30)]
    assert C.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 5
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
