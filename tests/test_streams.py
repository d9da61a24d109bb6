"""Versions from logs in any order: changes, retractions, bounded state."""

import datetime as dt
import random
from pathlib import Path

import pytest

from palimpsest.streaming import observations
from palimpsest.streaming.observations import closed_of, timeline, to_files, version_changes, with_rocksdb

SCHEMA = "entity string, record_hash string, observed_at timestamp"
START = dt.datetime(2026, 8, 1)


def plain(rows):
    out = set()
    for key in {r[0] for r in rows}:
        out |= {(key, *w) for w in timeline(None, list({(at, record) for k, record, at in rows if k == key}))}
    return out


def fed(spark, tmp_path, batches, lateness="10 days"):
    other = with_rocksdb(spark)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = other.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        to_files(version_changes(stream, "entity", "record_hash", "observed_at", lateness), f"{tmp_path}/out", f"{tmp_path}/check")
    return spark.read.schema(observations.CHANGES).parquet(f"{tmp_path}/out")


def test_timeline():
    a, b, c, d = (START + dt.timedelta(days=n) for n in range(4))
    assert timeline(None, [(c, "y"), (a, "x"), (b, "x"), (d, "x")]) == {("x", a, c), ("y", c, d)}
    assert timeline((a, "x"), [(b, "x"), (c, "z")]) == {("x", a, c)} and timeline(None, []) == set()


def test_a_late_row_takes_a_window_back(spark, tmp_path):
    a, b, c, d = (START + dt.timedelta(hours=n) for n in range(4))
    changes = fed(spark, tmp_path, [[("A", "x", a), ("A", "y", d)], [("A", "z", b), ("B", "u", a)], [("A", "x", c), ("A", "z", b)]])
    told = sorted(map(tuple, changes.collect()))
    assert ("A", "x", a, d, 1) in told and ("A", "x", a, d, -1) in told and ("A", "z", b, d, -1) in told
    assert set(map(tuple, closed_of(changes).collect())) == {("A", "x", a, b), ("A", "z", b, c), ("A", "x", c, d)}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_shuffled_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ABC"), rng.choice("xyz"), START + dt.timedelta(minutes=rng.randrange(400))) for _ in range(120)]
    changes = fed(spark, tmp_path, [rows[k::4] for k in range(4)])
    assert set(map(tuple, closed_of(changes).collect())) == plain(rows)


def test_state_holds_no_more_than_the_lateness(spark, tmp_path, monkeypatch):
    """Days that the watermark has passed are folded away, and versions go on over them."""
    days = [START + dt.timedelta(days=n) for n in range(8)]
    batches = [[("A", "xxyyzzzx"[n], day)] for n, day in enumerate(days)]
    changes = fed(spark, tmp_path, batches, "36 hours")
    want = plain([r for b in batches for r in b])
    assert set(map(tuple, closed_of(changes).collect())) == want and changes.where("change < 0").count() == 0
    state = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "seen").load()
    assert state.count() <= 4


def test_an_entitys_state_is_one_value_and_batches_do_not_grow_with_files(spark, small, tmp_path):
    from palimpsest.queries.files import stream_closed

    spark.read.parquet(f"{small}/events.parquet").where("user_id % 5 = 0").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("stream-*"))
    stream_closed(spark, str(tmp_path))
    (top,) = set(shared.glob("stream-*")) - before
    # A batch for each turn, and perhaps one after it for what the watermark has passed.
    assert sum(p.name.isdigit() for p in (top / "checkpoint/offsets").iterdir()) <= 6
    state = spark.read.format("statestore").option("path", f"{top}/checkpoint").option("stateVarName", "seen").load()
    assert state.count() == spark.read.parquet(f"{tmp_path}/events.parquet").select("user_id").distinct().count()


def test_the_sessions_setting_stays(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    assert with_rocksdb(spark).conf.get(name).endswith("RocksDBStateStoreProvider") and spark.conf.get(name) == before
    assert closed_of(spark.createDataFrame([], observations.CHANGES)).count() == 0
