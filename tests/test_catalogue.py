"""Every registered query against its SQL, and the driver's entry points."""

import datetime as dt
import math
import os

import pytest

from palimpsest import catalogue

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, oracle, name):
    df = catalogue.QUERIES[name](spark, small)
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_give_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)


def test_the_rest_does_not_import_the_corpus_operators():
    top = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "palimpsest")
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "palimpsest.llm" not in f.read(), n


def test_pushdown_and_pruning(spark, small):
    plan = catalogue.QUERIES["get_one"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan and "o_custkey" not in plan
    top = catalogue.QUERIES["top_proposals_by"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
    for name in ("scd2_asof_join", "merge_upsert", "search_full", "thread_join"):
        assert "CartesianProduct" not in catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
