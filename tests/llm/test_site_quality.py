from collections import defaultdict

import numpy as np
from lodestone.llm import site_quality as S


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = S.op10_site_quality(spark, sf)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_shrinkage_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["the", "of", "river", "##", "x!!", "boat"], int(rng.integers(1, 60)))), f"h{k % 4}" if k % 7 else None, "a" if k % 3 else None, "q") for k in range(200)]
    rows += [(500, None, "lonely", "a", "q"), (501, "", "", "", "q"), (501, "", "", "", "q"), (None, "the of " * 20000, "h1", "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, host string")
    labels = spark.createDataFrame([(k, int("##" not in rows[k][1]), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    c = S.fit(docs, labels)
    got = S.posteriors(docs, c).collect()
    assert len(got) == len(rows)
    p = lambda r: 1 / (1 + np.exp(-r.evidence))
    host, path = defaultdict(list), defaultdict(list)
    for r in got:
        host[r.host].append(p(r))
        path[r.host, r.path].append(p(r))
    mean = float(np.clip(sum(map(sum, host.values())) / len(rows), 0.01, 0.99))
    k1 = S._strength(mean, np.mean([(np.mean(v) - mean) ** 2 for v in host.values()]), np.mean([mean * (1 - mean) / len(v) for v in host.values()]))
    rate = {h: (sum(v) + k1 * mean) / (len(v) + k1) for h, v in host.items()}
    k2 = S._strength(mean, np.mean([(np.mean(v) - rate[h]) ** 2 for (h, _), v in path.items()]), np.mean([rate[h] * (1 - rate[h]) / len(v) for (h, _), v in path.items()]))
    for r in got:
        v = path[r.host, r.path]
        rest = (sum(v) - p(r) + k2 * rate[r.host]) / (len(v) - 1 + k2)
        z = r.evidence + S.SITE_WEIGHT * (np.log(rest / (1 - rest)) - np.log(mean / (1 - mean)))
        assert abs(r.posterior - 1 / (1 + np.exp(-z))) < 1e-6 and abs(r.host_rate - rate[r.host]) < 1e-9
    assert S.posteriors(docs.limit(0), c).count() == 0
    assert S.posteriors(docs, S.fit(docs, labels.limit(0))).count() == len(rows)
