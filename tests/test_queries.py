import duckdb
import pytest

from lodestone.plans import queries as Q

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, SF)
    if name not in Q.SQL:
        assert got.limit(1).count() == 1
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(repr(tuple(dict(sorted(zip(names, r))).values())) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in got.collect()) == rows
