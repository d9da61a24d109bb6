"""Statements read in pages."""

import tracemalloc

from palimpsest.sources.paged import sql_pages, sql_rows


def test_pages_in_order_and_bounded(spark):
    spark.range(0, 200_000, 1, 8).selectExpr("id", "repeat('x', 400) AS t").createOrReplaceTempView("many")
    tracemalloc.start()
    at = n = 0
    for page in sql_pages(spark, "select id, t from many where id >= :least order by id", 2000, least=1000):
        assert 0 < len(page) <= 2000 and page[0]["id"] == 1000 + at
        at, n = at + len(page), n + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == 199_000 and n >= 100 and peak < 20_000_000  # 80 MB of text in all


def test_rows_and_none(spark):
    assert sql_rows(spark, "select 1 as a, named_struct('b', 2) as s") == [{"a": 1, "s": {"b": 2}}]
    assert list(sql_pages(spark, "select 1 as a where false")) == []
