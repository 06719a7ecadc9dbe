import numpy as np
import pytest
from lodestone.llm import toxicity as T


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = T.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = [b"", b"abc", b"word", b"longer-than-twelve-bytes", "é".encode()]
    bucket, chars = T.encode(vocabulary)
    index, mask = rng.integers(0, 5, (6, 4)), np.ones((6, 4), bool)
    mask[3:, 1] = False
    y, weight, drop = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1]), np.ones(5)

    def loss():
        x = net.inputs(bucket, chars, drop)
        logit, _ = net.forward({d: (x @ net.p[f"w{d}"] + net.p[f"c{d}"])[index] for d in "fb"}, mask)
        return float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())

    g = net.train_step(bucket, chars, index, mask, y, weight, drop)
    for name, p in net.p.items():
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g[name]).ravel())[:3]]:
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert (up - down) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-4), name


def test_windows_reach_every_word():
    for n in range(0, 200):
        seen = {p for a in T.starts(n) for p in range(a, min(n, a + T.WINDOW))}
        assert seen == set(range(n))


def test_every_byte_of_a_word_counts():
    net = T.Network(2)
    spell = lambda w: net.inputs(*T.encode([w]))[0, T.WORD_DIM :]
    base = b"abcdefghijkl" + b"mnopqrstuvwxyz" * 3
    for k in range(len(base)):
        assert np.abs(spell(base) - spell(base[:k] + b"#" + base[k + 1 :])).max() > 1e-6, k
    _, both = T.encode([base, b"short", base + b"x"])
    assert (both[np.array([2, 0])].tail == np.r_[T.encode([base + b"x"])[1].tail, T.encode([base])[1].tail]).all()


def test_scorer_equals_a_plain_forward_of_each_window():
    rng = np.random.default_rng(4)
    net = T.Network(3)
    vocabulary = [bytes(rng.integers(97, 123, int(rng.integers(1, 30)), dtype=np.uint8)) for _ in range(300)]
    texts = [[vocabulary[k] for k in rng.integers(0, 300, n)] for n in (0, 1, 5, 31, 32, 33, 48, 49, 200, 1000)]
    scorer = T.Scorer(net, most=100)

    def plain(words):
        best = -np.inf
        for a in T.starts(len(words)):
            w = words[a : a + T.WINDOW] or [b""]
            x = net.inputs(*T.encode(w))
            mask = np.full((len(w), 1), bool(words))
            logit, _ = net.forward({d: (x @ net.p[f"w{d}"] + net.p[f"c{d}"])[:, None] for d in "fb"}, mask)
            best = max(best, float(logit[0]))
        return best

    want = [plain(t) for t in texts]
    for group in ([texts], [texts[:4], texts[4:]], [[t] for t in texts]):
        got = np.concatenate([scorer.top(g, batch=7) for g in group])
        assert np.allclose(got[1:], want[1:], atol=1e-4)


def test_repeated_ids_in_labels_and_documents(spark):
    docs = spark.createDataFrame([(k % 40, ("bad words here " if k % 2 else "good words there ") * (1 + k % 3), k) for k in range(80)], "key long, body string, doc_id int")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    one = T.fit(docs, labels, id_col="key", text_col="body")
    two = T.fit(docs.union(docs), labels.union(labels), id_col="key", text_col="body")
    assert all((one.p[k] == two.p[k]).all() for k in one.p) and one.calibration == two.calibration


def test_held_out_accuracy_and_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net = T.fit(docs, labels)
    rows = T.score(docs, net).join(labels, "doc_id").filter("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.93
    assert (s[y == 0] >= 0.3).mean() < 0.03
    edge = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "fine " * 40000, "c"), (3, "fine " * 40000, "c"), (None, "x", "d")], "doc_id long, text string, score string")
    got = T.score(edge, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.predicted for r in got}[2] == 0 and {r.doc_id: r.n_windows for r in got}[3] == 2499
    assert T.score(edge.limit(0), net).count() == 0
    none = T.fit(docs, labels.limit(0))
    assert {r.score for r in T.score(edge, none).collect()} == {0.5}
