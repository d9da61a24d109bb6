"""Calls to a paid embedder: within its bounds whatever the batches, billed as it says."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import embedding


def echo(texts):
    return [[float(len(t))] for t in texts]


def strict(texts):
    """Refuses what the API would."""
    words = sum(len(t.split()) for t in texts)
    assert len(texts) <= 5 and (words <= 20 or len(texts) == 1), (len(texts), words)
    return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))], "usage": {"total_tokens": words + 1}}


def rows(n=200):
    return [(i, None if i % 17 == 0 else "w " * (i * 7 % 13 + (40 if i % 50 == 3 else 0))) for i in range(n)]


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_calls_stay_within_bounds_across_arrow_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows(), "id int, chunk string").repartition(3)
        made = embedding.embed(df, strict, most_texts=5, most_tokens=20, calls=True).cache()
        assert {r.id: r.embedding for r in made.collect()} == {i: [float(len(t or ""))] for i, t in rows()}
        used = embedding.usage(made, 5, 20).first()
        words = sum(len((t or "").split()) for _, t in rows())
        assert used.texts == 200 and used.tokens == words and used.billed == words + used.calls
        assert (used.over_texts, used.over_tokens, used.early) == (0, 0, 0)
        places = made.groupBy("embed_call").agg(F.count("*").alias("n"), F.max("embed_place").alias("m"), F.count_if(F.col("embed_billed") > 0).alias("b")).collect()
        assert all(r.m == r.n - 1 and r.b == 1 for r in places) and len(places) == used.calls
        made.unpersist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_counts_of_ones_own_and_answers_without_usage(spark):
    df = spark.createDataFrame([(i, "abc" * i, i) for i in range(10)], "id int, t string, n int").coalesce(1)
    made = embedding.embed(df, echo, "t", "v", F.col("n"), most_texts=100, most_tokens=9, calls=True)
    calls = [r.texts for r in made.groupBy("embed_call").agg(F.count("*").alias("texts")).orderBy("embed_call").collect()]
    assert calls == [4, 2, 1, 1, 1, 1] and embedding.usage(made, 100, 9).first().billed == 45
    assert embedding.embed(df, echo, "t", "v").columns == ["id", "t", "n", "v"]
    used = embedding.usage(embedding.embed(df.limit(0), echo, "t", "v", calls=True)).first()
    assert (used.calls, used.texts, used.billed) == (0, 0, 0)


def test_what_an_answer_must_hold(spark):
    assert embedding.answered({"data": [{"index": 1, "embedding": [1.0]}, {"index": 0, "embedding": [0.0]}], "usage": {"total_tokens": 9}}, 2) == ([[0.0], [1.0]], 9)
    assert embedding.answered([[1.0]], 1) == ([[1.0]], None) and embedding.answered({"data": [[1.0]]}, 1)[1] is None
    with pytest.raises(ValueError):
        embedding.answered([[1.0]], 2)
    df = spark.createDataFrame([(1, "a")], "embed_call int, chunk string")
    with pytest.raises(ValueError):
        embedding.embed(df, echo)
