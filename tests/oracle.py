"""Spark-vs-DuckDB comparison used by the tests (same rules as tools/oracle_check.py)."""

import math
from collections import Counter

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(sdf, con, sql):
    cols = sdf.columns
    rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sc = Counter(tuple(norm(r[i]) for i in si) for r in rows)
    dc = Counter(tuple(norm(r[i]) for i in di) for r in drows)
    assert len(rows) == len(drows)
    assert sc == dc
    return len(rows)
