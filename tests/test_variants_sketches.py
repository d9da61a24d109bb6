"""Variants of drifting objects, sketches of distinct values, the tree of fingerprints."""

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.functions import variants
from palimpsest.operators import scd2, sketches


def test_paths_of_drifting_objects(spark):
    texts = ['{"a": 1, "b": {"c": [2, 3]}}', '{"a": "x"}', '{"a": "7"}', "[]", "{bad", None, '{"a": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string").withColumn("v", variants.parsed(F.col("p")))
    rows = variants.read_paths(df, "v", {"a": ("$.a", "bigint"), "c": ("$.b.c[1]", "int"), "none": ("$.x.y", "string")}).orderBy("i").collect()
    assert [r.a for r in rows] == [1, None, 7, None, None, None, None]
    assert [r.c for r in rows] == [3, *[None] * 6] and not any(r.none for r in rows)


def test_schemas_and_drift(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("a", '{"k": 2, "m": "x"}'), ("b", '{"z": true}')], "g string, p string").withColumn("v", variants.parsed(F.col("p")))
    before = variants.schemas(df.where("p like '%1%' or g = 'b'"), "v", "g")
    now = variants.schemas(df, "v", "g")
    assert {r.g: (r.objects, r.schema) for r in now.collect()}["a"] == (2, "OBJECT<k: BIGINT, m: STRING>")
    assert [(r.g, r.was) for r in variants.drifted(before, now, "g").collect()] == [("a", "OBJECT<k: BIGINT>")]
    assert variants.drifted(now.limit(0), now, "g").count() == 2


def test_sketches_are_near_the_exact_count_for_any_days(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("ab"[n % 2], start + dt.timedelta(hours=n % 240), n * 7919 % 5000) for n in range(20_000)] + [("a", start, None)]
    df = spark.createDataFrame(rows, "g string, at timestamp, u int")
    kept = sketches.daily_sketches(df, ["g"], "at", "u").cache()
    assert kept.count() == 20
    for a, z in ((0, 10), (2, 3), (5, 9)):
        days = [F.lit(str((start + dt.timedelta(days=n)).date())).cast("date") for n in (a, z)]
        exact = {r.g: (r.n, r.u) for r in df.where((F.to_date("at") >= days[0]) & (F.to_date("at") < days[1])).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).collect()}
        for r in sketches.united(kept, ["g"], *days).collect():
            assert r.rows == exact[r.g][0] and abs(r.distinct - exact[r.g][1]) <= 0.05 * exact[r.g][1]
    kept.unpersist()


def test_fingerprints_tell_tables_apart(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    same = df.repartition(7).orderBy(F.rand(1))
    one = lambda t: scd2.exact_fingerprint(t, "h").first().fingerprint
    assert one(df) == one(same)
    assert one(df) != one(df.unionByName(df.limit(1))) != one(df.where("h > '1'"))
    assert one(df.limit(0)) == one(df.limit(0)) and one(df.limit(0)) is not None
    extra = df.unionByName(spark.createDataFrame([("ab" * 32,)], "h string"))
    a, b = (scd2.fingerprint_ranges(t, "h", 2) for t in (df, extra))
    assert [r.range for r in b.join(a, ["range", "digest"], "left_anti").collect()] == ["ab"]
    hot = df.unionByName(spark.range(5000).select(F.lit("cd" * 32).alias("h")))
    assert one(hot) == one(hot.repartition(5))
