"""Versions: the golden timeline, ties, reverts, attribute-only changes, as-of access, merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import scd2, upsert

T = [dt.datetime(2026, 8, n, 12) for n in (1, 2, 3, 4)]
LOG = [("A", "a1", T[0]), ("A", "a2", T[1]), ("A", "a3", T[2]), ("B", "b1", T[1]), ("C", "c1", T[0]), ("C", "c1", T[1])]
SCHEMA = "entity string, record_hash string, observed_at timestamp"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def folded(spark):
    return scd2.versions(spark.createDataFrame(LOG, SCHEMA), ["entity"])


def test_golden_windows(folded):
    assert rows(folded, "entity", "record_hash", "valid_from", "is_current") == [
        ("A", "a1", T[0], False), ("A", "a2", T[1], False), ("A", "a3", T[2], True), ("B", "b1", T[1], True), ("C", "c1", T[0], True),
    ]
    assert {(r.entity, r.record_hash): r.valid_to for r in folded.collect()} == {("A", "a1"): T[1], ("A", "a2"): T[2], ("A", "a3"): None, ("B", "b1"): None, ("C", "c1"): None}


@pytest.mark.parametrize(("at", "want"), [(T[0] - dt.timedelta(seconds=1), []), (T[0], ["a1", "c1"]), (T[1], ["a2", "b1", "c1"]), (T[3], ["a3", "b1", "c1"])])
def test_as_of(folded, at, want):
    assert [r[0] for r in rows(scd2.as_of(folded, F.lit(at)), "record_hash")] == want


def test_ties_are_ordered_by_record(spark):
    df = scd2.versions(spark.createDataFrame([("A", "y", T[0]), ("A", "x", T[0])], SCHEMA), ["entity"])
    assert rows(df, "record_hash", "is_current") == [("x", False), ("y", True)]


def test_a_revert_is_the_same_record(spark):
    df = scd2.versions(spark.createDataFrame([("A", "x", T[0]), ("A", "y", T[1]), ("A", "x", T[2])], SCHEMA), ["entity"])
    assert rows(df, "record_hash", "valid_from", "is_current") == [("x", T[0], False), ("y", T[1], True)]


@pytest.mark.parametrize(("keep", "quorum"), [("first", 1), ("last", 2)])
def test_attribute_only_changes(spark, keep, quorum):
    df = spark.createDataFrame([("A", "x", T[0], 1), ("A", "x", T[1], 2)], SCHEMA + ", quorum int")
    found = scd2.first_observations(df, ["entity"], keep=keep)
    assert rows(found, "quorum", "observed_at") == [(quorum, T[0])]


def test_invariants(spark, folded):
    assert scd2.not_one_current(folded, ["entity"]).count() == 0
    assert scd2.gaps(folded, ["entity"]).count() == 0
    broken = folded.withColumn("valid_to", F.lit(None).cast("timestamp"))
    assert scd2.gaps(broken, ["entity"]).count() == 2


def test_as_of_join_takes_the_version_then_valid(spark, folded):
    facts = spark.createDataFrame([(1, "A", T[0] - dt.timedelta(1)), (2, "A", T[1]), (3, "A", T[3]), (4, "Z", T[0])], "id int, entity string, at timestamp")
    found = scd2.as_of_join(facts, folded.withColumnRenamed("record_hash", "state"), ["entity"], "at", ["state"])
    assert rows(found, "id", "state") == [(1, None), (2, "a2"), (3, "a3"), (4, None)]


def test_merge_actions(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (3, "c", 3.0), (4, "d", 4.0)], "k int, s string, x double")
    staged = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (5, "e", 5.0)], "k int, s string, x double")
    found = {r.k: (r.action, r.x) for r in upsert.actions(target, staged, ["k"]).collect()}
    assert found == {1: ("update", 1.0), 2: ("update", None), 3: ("keep", 3.0), 4: ("keep", 4.0), 5: ("insert", 5.0)}


def test_a_merge_without_changes_writes_nothing(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"), ["s"])
    first = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, x double")
    assert table.merge(first, ["k"]) == {"inserts": 2, "updates": 0}
    assert table.merge(first, ["k"]) == {"inserts": 0, "updates": 0}
    assert table.versions() == [1]
    assert table.merge(first.withColumn("x", F.lit(9.0)), ["k"]) == {"inserts": 0, "updates": 2}
    assert [r.x for r in table.read(1).orderBy("k").collect()] == [1.0, None]
    assert {r.x for r in table.read().collect()} == {9.0}
    (tmp_path / "t" / "v=3").mkdir()  # a writer that died
    assert table.versions() == [1, 2]


def test_insert_if_absent_takes_the_first_of_a_key(spark):
    staged = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, h string")
    known = spark.createDataFrame([("y",)], "h string")
    assert rows(upsert.only_new(staged, known, ["h"], ["id"]), "id") == [(1,)]


def test_fill_first_keeps_what_no_lookup_has(spark):
    target = spark.createDataFrame([("x", "old"), ("z", "own")], "h string, title string")
    lookup = spark.createDataFrame([("x", "b", 2), ("x", "a", 1)], "h string, title string, n int")
    assert rows(upsert.fill_first(target, lookup, "h", ["title"], ["n"]), "h", "title") == [("x", "a"), ("z", "own")]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("ab" * 32,), ("cd" * 32,)], "h string")
    assert scd2.fingerprint(a, "h").collect() == scd2.fingerprint(a.orderBy(F.desc("h")), "h").collect()
    assert scd2.exact_fingerprint(a, "h").collect() == scd2.exact_fingerprint(a.orderBy(F.desc("h")), "h").collect()


def files_of(table, version=None):
    return {r.file for r in table.files(version).collect()}


def test_a_merge_rewrites_only_buckets_that_change(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"))
    table.merge(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("s")), ["k"])
    one = spark.createDataFrame([(7, "b")], "k long, s string")
    assert table.merge(one, ["k"]) == {"inserts": 0, "updates": 1}
    before, after = files_of(table, 1), files_of(table, 2)
    assert len(before & after) == len(before) - 1 == len(after) - 1
    assert sorted((r.k, r.s) for r in table.read().where("s <> 'a' or k < 2").collect()) == [(0, "a"), (1, "a"), (7, "b")]
    assert table.read().count() == 200 and table.read(buckets=table.buckets_of(one.select("k"))).where("k = 7").count() == 1
    assert [(r.version, r.operation, r.summary.get("updates")) for r in table.history().orderBy("version").collect()] == [(1, "write", None), (2, "merge", "1")]
    with pytest.raises(ValueError):
        table.merge(one, ["s"])


def test_logs_only_grow(spark, tmp_path):
    log = upsert.VersionedTable(spark, str(tmp_path / "t"), bucket_by=["k"])
    first = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (1, 1)], "k int, at int")
    assert log.append_new(first, ["k", "at"]) == 3
    assert log.append_new(first, ["k", "at"]) == 0 and log.versions() == [1]
    assert log.append_new(spark.createDataFrame([(1, 9), (None, 3)], "k int, at int"), ["k", "at"]) == 1
    assert files_of(log, 1) < files_of(log, 2)
    assert sorted((r.k or 0, r.at) for r in log.read().collect()) == [(0, 3), (1, 1), (1, 2), (1, 9)]


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    a = upsert.VersionedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    a.write(df, ["k"])
    real = a._put

    def meanwhile(*args):
        made = real(*args)
        upsert.VersionedTable(spark, str(tmp_path / "t")).merge(df.withColumn("s", F.lit("other")), ["k"])
        return made

    monkeypatch.setattr(a, "_put", meanwhile)
    with pytest.raises(upsert.ConcurrentWrite):
        a.merge(df.withColumn("s", F.lit("late")), ["k"])
    assert [r.s for r in a.read().collect()] == ["other"] and a.versions() == [1, 2]


def test_insert_if_absent_of_null_keys(spark):
    staged = spark.createDataFrame([(1, None), (2, "y")], "id int, h string")
    assert rows(upsert.only_new(staged, staged, ["h"]), "id") == []
    assert rows(upsert.only_new(staged, staged.limit(0), ["h"]), "id") == [(1,), (2,)]


def test_statements_end_at_semicolons_outside_quotes():
    ddl = "a 'x;''y';\n-- no; comment\nb \"q;\" `c;d` /* e; */ f - g / h;;"
    assert upsert.statements(ddl) == ["a 'x;''y'", 'b "q;" `c;d`  f - g / h']
