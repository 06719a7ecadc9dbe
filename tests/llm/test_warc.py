import glob
import hashlib

import pytest
import zstandard
from lodestone.llm import warc as W

from .util import against_sql


def test_sql(spark):
    against_sql(spark, W.op1_warc, W.OP1_SQL)


def test_round_trip_and_random_access(spark, tmp_path, monkeypatch):
    big = "é" * 400_000
    rows = [(5, "http://a/b c\r\nX: y", "<p>" * 50), (2, None, "<p>" * 50), (7, "u", None), (8, "u", ""), (9, "u", "short"), (3, "v", "short"), (1, "w", big), (4, "w", big), (4, "w", big), (None, "n", big), (6, "x", "q" * 700_000)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    index = W.write_bundles(pages, str(tmp_path / "out"))
    got = {(r.page_id, r.record_type): r for r in W.read_bundles(index).collect()}
    assert len(got) == len(rows) - 1 and W.read_bundles(index).count() == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for (i, kind), r in got.items():
        assert r.payload_digest == hashlib.sha256(html[i]).hexdigest() and r.payload_bytes == len(html[i])
        assert r.payload == (html[i] if kind == "response" else None)
    assert got[5, "revisit"].refers_to == 2 and got[4, "revisit"].refers_to == 1 and got[None, "revisit"].refers_to == 1
    assert got[9, "response"].refers_to is None and (8, "response") in got and (7, "response") in got
    for r in index.collect():
        head, _ = W.read_record(r.bundle, r.frame, r.offset)
        assert W.page_of(head["WARC-Record-ID"]) == r.page_id
    for path in glob.glob(f"{tmp_path}/out/*.warc.zst"):  # any reader of Zstandard can read a bundle as a whole
        with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as z:
            assert z.read().startswith(b"WARC/1.1\r\n")
    empty = W.write_bundles(pages.limit(0), str(tmp_path / "none"))
    assert W.read_bundles(empty).count() == 0


def test_damage_is_found():
    data = W.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), 3, None)
    with pytest.raises(ValueError):
        W._row(*W.parse(data, 0)[:2])
