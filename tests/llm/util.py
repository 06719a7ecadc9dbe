import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def against_sql(spark, query, sql, sf="/root/testdata/sf0.01"):
    """The query's rows equal the SQL's rows, whatever the order."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    rows = sorted(map(repr, (tuple(dict(sorted(zip(names, r))).values()) for r in want.fetchall())))
    got = query(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in got.collect()) == rows
