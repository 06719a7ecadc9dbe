from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from lodestone.llm import substring_dedup as S


def brute_lines(rows):
    """(doc_id, start) -> first occurrence of its class, by all pairs of lines."""
    lines = []
    for d, t in rows:
        at = 0
        for line in (t or "").encode().lower().split(b"\n"):
            w = line.split()
            if len(w) >= S.MIN_WORDS:
                lines.append(((d, at), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(w)
    root = {u: u for u, _ in lines}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    by = defaultdict(list)
    for k, (_, s) in enumerate(lines):
        for g in s:
            by[g].append(k)
    pairs = {p for ks in by.values() for p in combinations(ks, 2)}
    for i, j in pairs:
        (u, a), (v, b) = lines[i], lines[j]
        if len(a & b) >= 0.8 * len(a | b):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    n = defaultdict(int)
    for u in root:
        n[find(u)] += 1
    return {u: find(u) for u in root if n[find(u)] > 1}


def test_lines_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_lines(rows)
    ends = {(d, s): None for d, s in want}
    got = {(r.doc_id, r.start): (r.first_doc_id, r.first_start) for r in S.duplicate_spans(docs).collect() if (r.doc_id, r.start) in ends}
    found = sum(got.get(u) is not None for u in want)
    assert found >= 0.99 * len(want) and len(want) > 20


def test_every_passage_of_50_words_is_caught(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passages = [word(50) for _ in range(40)]
    rows = []
    for k, p in enumerate(passages):
        rows += [(10 * k, word(int(rng.integers(0, 60))) + " " + p + " " + word(9)), (10 * k + 1, word(33) + "\n" + word(3) + " " + p)]
    clean = [(10 * k + 5, word(200)) for k in range(40)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in S.duplicates(docs).collect()}
    assert set(got) == {d for d, _ in rows}
    assert all((got[d].n_removed_words > 0) == (d % 10 == 1) for d in got)
    left = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert all(p in left[10 * k] and p not in left[10 * k + 1] for k, p in enumerate(passages))
    assert all(left[d] == t for d, t in clean)


def test_edge_rows(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, line), (4, line + "\nshort"), (5, "z " * 30000), (6, "z " * 50), (None, line), (7, line), (7, line), (8, "few words")]
    docs = spark.createDataFrame([(*r, 3, "k", 9) for r in rows], "doc_id long, text string, start int, spans string, n_chars int")
    got = {r.doc_id: r for r in S.duplicates(docs).collect()}
    assert got[3].n_removed_words == 0 and got[4].n_removed_words == 40 and got[7].n_removed_words == 40 and got[6].first_doc_ids[0] == 5
    left = S.remove_repeats(docs)
    assert left.columns == docs.columns
    out = {(r.doc_id, r.text) for r in left.collect()}
    assert {(1, None), (2, ""), (3, line), (4, "short"), (None, line), (8, "few words")} <= out and all(d != 7 for d, _ in out)
    assert S.duplicates(docs.limit(0)).count() == 0 and S.remove_repeats(docs.limit(0)).count() == 0


def test_hot_list_in_blocks_keeps_every_link(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        w = list(base)
        w[k] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    units = S.keyed(docs).mapInArrow(S._units, S.UNITS).filter("bands is not null").cache()
    words = [S.Words([r.text.encode()]) for r in docs.collect()]
    sets = [(int(w.line_hashes(S._A).view(np.int64)[0]), int(w.line_hashes(S._B).view(np.int64)[0]), S._grams(w.x[:60], 5, S._A).tobytes()) for w in words]
    edges = S.line_links(S.band_lists(units), spark.createDataFrame(sets, "h1 long, h2 long, shingles binary"), list_cap=4)
    nodes = {(r.node.h1, r.node.h2): (r.component.h1, r.component.h2) for r in S.connected_components(edges, "a", "b").collect()}
    assert len(nodes) == len(want) == 30 and len(set(nodes.values())) == 1


def test_passages_are_covered_whole(spark):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    rows, want = [], {}
    for k in range(120):
        n = (49, 51, 60, 80, 120, 300)[k % 6]
        # Much else in the lines, so that they aren't similar as lines.
        p, head, tail = word(n), n // 2 + int(rng.integers(1, 70)), n // 2 + int(rng.integers(1, 40))
        first, later = (word(head), word(tail)), (word(tail), word(head))
        # A smaller id holds some words of the passage among others: the anchors' classes differ.
        part = p.split()[n // 3 :][:40]
        rows += [(10 * k, f"{word(50)} {' '.join(part)} {word(50)}"), (10 * k + 1, f"{first[0]} {p} {first[1]}"), (10 * k + 2, f"{later[0]} {p} {later[1]}")]
        want[10 * k + 2] = (tail, tail + n, f"{later[0]} {later[1]}")
        want[10 * k + 1] = (head, head + n, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.duplicates(docs).collect()}
    left = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    for d, (start, end, text) in want.items():
        assert [tuple(s) for s in got[d].spans] == [(start, end)]
        if text is not None:
            assert [tuple(s) for s in got[d].removed_spans] == [(start, end)] and left[d] == text


def brute_passages(rows, n=S.PASSAGE):
    """Places of the words in runs of n words that also occur elsewhere, and in later ones:
    row -> (repeated, later)."""
    at = defaultdict(list)
    words = [(t or "").lower().split() for _, t in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append((rows[k][0], k, i))
    some, later = defaultdict(set), defaultdict(set)
    for places in at.values():
        for d, k, i in places:
            if len(places) > 1:
                some[k] |= set(range(i, i + n))
            if (d, k, i) != min(places):
                later[k] |= set(range(i, i + n))
    return some, later


@pytest.mark.parametrize("cap", [2000, 3])
def test_passages_equal_brute_force(spark, cap):
    rng = np.random.default_rng(11)
    fresh = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    common, rows = [fresh(n) for n in (49, 60, 90, 200)], []
    for k in range(160):
        w = fresh(int(rng.integers(0, 40)))
        for _ in range(int(rng.integers(1, 4))):
            p = common[int(rng.integers(0, 4))]
            a = int(rng.integers(0, max(1, len(p) // 3)))
            w += [*p[a if k % 2 else 0 :], *fresh(int(rng.integers(5, 60)))]
        # No line has MIN_WORDS words, and blank ones keep them apart.
        rows.append((k // 2 if k < 20 else k, "\n\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some, later = brute_passages(rows)
    number = {t: k for k, (_, t) in enumerate(rows)}
    t_of = {r.t: number[r.text] for r in S.keyed(docs).collect()}
    covered, gone = defaultdict(set), defaultdict(set)
    for r in S.duplicates(docs, list_cap=cap).collect():
        covered[t_of[r.t]] = {p for s in r.spans for p in range(s.start, s.end)}
        gone[t_of[r.t]] = {p for s in r.removed_spans for p in range(s.start, s.end)}
    apart = {k for k in range(len(rows)) for w in [rows[k][1].split()] if len(set(w)) == len(w)}
    assert len(apart) > 60
    for k in range(len(rows)):
        assert some[k] <= covered[k], k
        if k in apart and rows[k][0] >= 10:
            assert later[k] <= gone[k], k
    # Beyond that only what matches of fewer words, joined without a gap, make together.
    short, _ = brute_passages(rows, S.ANCHOR)
    assert all(covered[k] <= short[k] for k in apart)
    assert sum(len(covered[k] - some[k]) for k in apart) <= 0.001 * sum(map(len, some.values()))


def test_repeated_ids_have_their_own_spans(spark):
    line = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(45))
    rows = [(3, line), (9, line), (9, "unique short text"), (9, other), (9, line), (10, "a b\n" + "c d e f g h\n" * 1)]
    left = sorted((r.doc_id, r.text) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted([rows[0], rows[2], rows[3], rows[5]])


def test_wrapped_paragraphs_are_one(spark):
    w = [f"w{i}" for i in range(60)]
    wrap = lambda x, n: "\n".join(" ".join(x[i : i + n]) for i in range(0, len(x), n))
    changed = [*w[:30], "else", *w[31:]]
    rows = [(1, "short head\n\n" + wrap(w, 9)), (2, wrap(changed, 11) + "\n\nother words here"), (3, wrap([f"u{i}" for i in range(60)], 9))]
    got = {r.doc_id: r for r in S.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2} and [tuple(s) for s in got[2].removed_spans] == [(0, 60)] and [tuple(s) for s in got[1].spans] == [(2, 62)]


def test_a_word_over_and_over_is_bounded(spark):
    rows = [(1, "z " * 100_000), (2, "y " * 300 + "x"), (3, "q " + "y " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = S.keyed(docs).mapInArrow(S._units, S.UNITS).filter("bands is null").collect()
    assert sum(r.start for r in units) < 2 * 100_600 / S.WINNOW
    got = {r.doc_id: r for r in S.duplicates(docs).collect()}
    assert got[3].n_removed_words > 200 and got[1].removed_spans[0].start >= S.PASSAGE
