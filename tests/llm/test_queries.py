"""Corpus queries against their SQL on whole tables."""

import pytest

from palimpsest.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df, want = QUERIES[name](spark, d), c.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
