import re
from collections import Counter

from lodestone.llm import quality_rules as Q

from .util import against_sql


def brute_repeat(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    return len({p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 8)})


def test_sql(spark):
    against_sql(spark, Q.op5_quality_rules, Q.OP5_SQL)


def test_edge_rows(spark):
    good = "the river is wide and the boat on it was small but it came to shore with all of us in it at noon"
    texts = [None, "", " \n", "a", "x " * 8, "x " * 9, good, good + " " + good, "y " * 20000, "   x é\n\né\né", good + "\n" + good[:9]]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r.row.doc_id: r for r in Q.judge(docs).collect()}
    assert [got[i].n_repeat_words for i in range(len(texts))] == [brute_repeat(t) for t in texts]
    assert got[6].kept and not got[7].kept and not got[0].kept and got[0].n_words == 0
    assert got[9].n_dup_lines == 1 and got[9].n_lines == 3
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 10]
    assert Q.judge(docs.limit(0)).count() == 0


def test_the_plan_runs_no_python(spark):
    plan = Q.op5_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = Q.op5_quality_rules(spark, sf).join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in found.filter("n_words >= 20").groupBy("quality", "kept").count().collect()}
    print(n)
    assert n.get((1, False), 0) <= 0.005 * n[(1, True)]
    assert n[(0, False)] >= 0.9 * (n[(0, False)] + n.get((0, True), 0))
