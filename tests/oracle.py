"""Compare a query with its SQL, row by row, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)


def same(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = query(spark, folder), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(_cell(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(_cell(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
