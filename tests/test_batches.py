"""Greedy batches against one pass, over many blocks and partitions."""

import random

import pytest

from palimpsest.operators.batches import greedy_batches


def plain(weights, most_rows, most_weight):
    out, batch, rows, total = [], 0, 0, 0
    for w in weights:
        w = w or 0
        if rows and (rows >= most_rows or total + w > most_weight):
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + 1, total + w
        out.append(batch)
    return out


@pytest.mark.parametrize(("n", "most_rows", "most_weight", "block"), [(1, 2, 10, None), (7, 2, 10, None), (3000, 5, 40, 20), (3000, 8, 10**9, 32), (2000, 500, 60, None), (257, 8, 30, 32), (64, 8, 30, 32), (66, 8, 1, 32)])
def test_against_one_pass(spark, n, most_rows, most_weight, block):
    rng = random.Random(n)
    weights = [rng.choice([0, 1, 5, rng.randint(0, 45), None]) for _ in range(n)]
    df = spark.createDataFrame([(i, w, f"t{i}") for i, w in enumerate(weights)], "i int, w long, t string").repartition(5)
    found = greedy_batches(df, "w", ["i"], most_rows, most_weight, block)
    assert [r.batch for r in found.orderBy("i").collect()] == plain(weights, most_rows, most_weight)
    assert found.columns == ["i", "w", "t", "batch"]


def test_first_rows(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([5, 5, 5, 20, 1, 1, 1])], "i int, w long")
    assert [r.batch for r in greedy_batches(df, "w", ["i"], 2, 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_a_key_that_all_rows_share(spark):
    df = spark.createDataFrame([(0, 1, "same")] * 500 + [(1, 7, "x")], "i int, w int, t string").repartition(4)
    found = greedy_batches(df, "w", ["i"], 10, 1000, 64)
    sizes = sorted(r["count"] for r in found.groupBy("batch").count().collect())
    assert sizes == [1] + [10] * 50 and found.where("i = 1").first().batch == 50


def test_nothing_and_clashes(spark):
    df = spark.createDataFrame([], "i int, w long")
    assert greedy_batches(df, "w", ["i"]).count() == 0
    with pytest.raises(ValueError):
        greedy_batches(df.withColumnRenamed("i", "batch"), "w", ["batch"])


def test_no_partition_holds_all(spark):
    df = spark.range(20_000).selectExpr("id AS i", "id % 7 AS w")
    found = greedy_batches(df, "w", ["i"], 16, 60, 1024)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString() and "Repartition 1," not in plan
    assert [r.batch for r in found.orderBy("i").collect()] == plain([i % 7 for i in range(20_000)], 16, 60)
