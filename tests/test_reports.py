"""Reports: links, volumes, differences, checks of text."""

from pyspark.sql import functions as F

from palimpsest.plans import reports


def test_links_and_volumes(spark):
    docs = spark.createDataFrame([("https://a.org/t/7/x",), ("https://a.org/t/8",), ("https://b.org/none",), (None,), ("https://a.org/99999999999999999999",), ("https://b.org/7",)], "u string")
    topics = spark.createDataFrame([(7, "x"), (8, "y"), (9, "x")], "id long, kind string")
    joined = reports.linked(docs, "u", topics, "id")
    assert sorted((r.host, r.id) for r in joined.collect()) == [("a.org", 7), ("a.org", 8), ("b.org", 7)]
    assert sorted(map(tuple, reports.volume(joined, ["host"], "n", kinds="kind").collect())) == [("a.org", 2, 2), ("b.org", 1, 1)]


def test_counts_and_differences(spark):
    posts = spark.createDataFrame([(t,) for t in [1, 1, 1, 2, 2, 3, 3, 4]], "t int")
    assert [tuple(r) for r in reports.busiest(posts, "t", 3).collect()] == [(1, 3), (2, 2), (3, 2)]
    assert {r.chunk_scheme: r.n for r in reports.by_scheme(posts, "t").collect()} == {1: 3, 2: 2, 3: 2, 4: 1}
    assert sorted(r.t for r in reports.missed(posts, posts.where("t > 2"), ["t"]).collect()) == [1, 2]


def test_checks_of_text(spark):
    df = spark.createDataFrame([("Aave — x", "Title of it"), ("b", "b"), ("say TITLE", "Title"), (None, "x"), ("x", None)], "t string, h string")
    rows = df.select(reports.lacks_prefix(F.col("t"), "Aave —", "ENS —"), reports.lacks_start_of(F.col("t"), F.col("h")), reports.mentions(F.col("t"), "Title")).collect()
    assert [tuple(r) for r in rows] == [(False, True, False), (True, False, False), (True, True, True), (None, None, None), (True, None, False)]
