"""Logs and tables that stay one scan, however often they are written."""

from pyspark.sql import functions as F

from palimpsest.operators.log import Log
from palimpsest.operators.upsert import VersionedTable


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, at int")


def test_a_thousand_appends_are_one_scan(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/l", ["k"], buckets=4)
    # A thousand batches at once: what a thousand appends leave, without the time they take.
    rows = spark.range(1000).select((F.col("id") % 7).cast("int").alias("k"), F.col("id").cast("int").alias("at"))
    log._put(rows.withColumns({"__bucket": log.bucket(), "__batch": F.col("at").cast("long")}))
    log.append(frame(spark, [(1, 5000), (1, 5000)]), 1000)
    found = log.read(rows.schema)
    assert scans(found) == 1 and found.count() == 1001
    some = log.read(rows.schema, log.touched(frame(spark, [(1, 0)])))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert scans(some) == 1 and "PartitionFilters: [isnotnull(__bucket" in plan and some.where("k = 1").count() == 144
    assert log.compact(rows.schema, 1000) == 996 and log.read(rows.schema).count() == 1001
    assert log.compact(rows.schema, 1000) == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/l", ["k"])
    schema = frame(spark, []).schema
    assert log.read(schema).count() == 0 and log.compact(schema, 9) == 0
    for _ in range(2):
        log.append(frame(spark, [(1, 1), (2, 2), (None, 3)]), 0)
        log.append(frame(spark, [(1, 4), (1, 1)]), 1)
    found = lambda: sorted((r.k or 0, r.at) for r in log.read(schema).collect())
    assert found() == [(0, 3), (1, 1), (1, 1), (1, 4), (2, 2)]
    log.compact(schema, 2)
    assert found() == [(0, 3), (1, 1), (1, 4), (2, 2)]


def test_a_table_is_one_scan_after_many_merges(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", ["p"], buckets=8)
    for n in range(6):
        table.merge(spark.createDataFrame([(k, "ab"[k % 2], n) for k in range(n, n + 3)], "k int, p string, v int"), ["k", "p"])
    assert scans(table.read()) == 1
    assert sorted(map(tuple, table.read().collect())) == sorted((k, "ab"[k % 2], min(k, 5)) for k in range(8))
    assert table.files().count() == len(set(r.file for r in table.files().collect())) and scans(table.read(3)) == 1


def test_buckets_by_size_and_split(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", buckets=8)
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    table.write(df, ["k"])
    assert table.wanted_buckets() == 8 and table.rebucket() == 1
    monkeypatch.setattr(VersionedTable, "BYTES", 16)
    assert table.wanted_buckets() > 64
    monkeypatch.undo()
    version = table.rebucket(256)
    assert table.read().count() == 500 and table.files(version).select("bucket").distinct().count() > 64
    assert table.merge(df.where("k = 3").withColumn("v", F.lit("y")), ["k"]) == {"inserts": 0, "updates": 1}
    assert table.read().where("v = 'y'").count() == 1 and table.read(1).where("v = 'y'").count() == 0
