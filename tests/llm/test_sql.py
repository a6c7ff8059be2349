"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pixelbrook.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    plain = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
