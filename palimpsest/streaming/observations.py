"""Observation logs as streams: first-seen records, open versions, recomputed windows, calendars and sessions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palimpsest.operators.log import Log
from palimpsest.operators.scd2 import versions
from palimpsest.operators.upsert import VersionedTable
from palimpsest.shipping import ship


def first_seen(stream: DataFrame, keys: list[str], record: str, observed: str, lateness: str = "1 day") -> DataFrame:
    """Each record of an entity once within the watermark."""
    return stream.withWatermark(observed, lateness).dropDuplicatesWithinWatermark([*keys, record])


def fold_into(stream: DataFrame, table: VersionedTable, log: Log, checkpoint: str, record: str = "record_hash", observed: str = "observed_at") -> StreamingQuery:
    """Take what is there and stop: each batch joins the log, and the versions of touched entities are folded anew.

    Late observations re-splice their entity's timeline, as folding is a pure function of the set of observations. Log and
    table are bucketed by entity (the log's keys), so a batch reads and writes the buckets of its own entities, by one scan
    of the log whatever came before; a batch that is replayed after a failure changes nothing.
    """
    table.bucket_by = log.keys

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            log.append(batch, number)
            touched = batch.select(*log.keys).distinct()
            rows = log.read(batch.schema, log.touched(touched)).join(touched, log.keys, "left_semi")
            table.merge(versions(rows, log.keys, record, observed), [*log.keys, record])
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OpenVersion(StatefulProcessor):
    """Holds an entity's open version; a later record closes it. Rows: key, record, valid_from, valid_to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "record string, valid_from timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["observed_at", "record"])
        held, closed = self.open.get(), []
        for record, at in zip(pdf["record"], pdf["observed_at"], strict=True):
            if held is not None and held[0] != record:
                closed.append((str(key[0]), held[0], held[1], at))
            if held is None or held[0] != record:
                held = (record, at)
        self.open.update(held)
        yield pd.DataFrame(closed, columns=["key", "record", "valid_from", "valid_to"])

    def close(self) -> None:
        pass


CLOSED = "key string, record string, valid_from timestamp, valid_to timestamp"


def closed_versions(stream: DataFrame, key: str, record: str, observed: str) -> DataFrame:
    """Versions as they close, for logs that arrive in order; needs the RocksDB state store."""
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(record).alias("record"), F.col(observed).alias("observed_at"))
    return rows.groupBy("key").transformWithStateInPandas(OpenVersion(), outputStructType=CLOSED, outputMode="Append", timeMode="None")


def timeline(begin: tuple | None, seen: list[tuple]) -> set[tuple]:
    """Closed windows (record, valid_from, valid_to) of observations (time, record) after an open version ``begin``
    (valid_from, record): a version lasts until the next record differs; at one time, records are in their own order."""
    out, held = set(), begin
    for at, record in sorted(seen):
        if held is not None and held[1] != record:
            out.add((held[1], held[0], at))
        if held is None or held[1] != record:
            held = (at, record)
    return out


class Timeline(StatefulProcessor):
    """Holds an entity's observations since the watermark, and the version that was open at it.

    Whatever a batch adds, late rows included, changes some closed windows: those that are no more are taken back
    (change -1), the new ones given (+1). A timer at each entity's oldest observation folds what the watermark has
    passed into the open version, as nothing earlier can come any more: state holds no more than the lateness allowed.
    All of an entity is one value, so a batch asks the state store for it once and puts it back once, whatever its number
    of observations; a timer moves only if the oldest observation does. Times are microseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "open_since long, open_record string, observed_at array<long>, record array<string>")

    def _held(self) -> tuple[tuple | None, list[tuple]]:
        """The open version (valid_from, record), and the observations (time, record) in their order."""
        found = self.seen.get()
        if found is None:
            return None, []
        return (None if found[0] is None else (found[0], found[1])), list(zip(found[2], found[3], strict=True))

    def _hold(self, begin: tuple | None, seen: list[tuple]) -> None:
        self.seen.update((*(begin or (None, None)), [at for at, _ in seen], [record for _, record in seen]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        begin, held = self._held()
        new = {(r.at, r.record) for r in rows}.difference(held)
        if not new:
            return
        both = sorted([*held, *new])
        self._hold(begin, both)
        if not held or both[0][0] < held[0][0]:
            if held:
                self.handle.deleteTimer(due(held[0][0]))
            self.handle.registerTimer(due(both[0][0]))
        before, after = timeline(begin, held), timeline(begin, both)
        for windows, n in ((before - after, -1), (after - before, 1)):
            for record, since, until in sorted(windows):
                yield Row(key=str(key[0]), record=record, since=since, until=until, change=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        begin, held = self._held()
        n = bisect_left(held, (passed,))
        for at, record in held[:n]:
            if begin is None or begin[1] != record:
                begin = (at, record)
        self._hold(begin, held[n:])
        if held[n:]:
            self.handle.registerTimer(due(held[n][0]))
        return iter(())

    def close(self) -> None:
        pass


def due(at: int) -> int:
    """The millisecond after a time in microseconds."""
    return at // 1000 + 1


CHANGES = f"{CLOSED}, change int"
#: What the state gives, times in microseconds.
TOLD = "key string, record string, since long, until long, change int"


def version_changes(stream: DataFrame, key: str, record: str, observed: str, lateness: str = "1 day") -> DataFrame:
    """Closed versions from a log in any order within ``lateness``: rows with change 1 give a window, those with -1 take
    back one that a late observation has split or moved. Repeated observations change nothing. ``closed_of`` sums them
    up. Needs the RocksDB state store."""
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(record).alias("record"), F.unix_micros(observed).alias("at"), F.col(observed).alias("observed_at"))
    told = rows.withWatermark("observed_at", lateness).groupBy("key").transformWithState(Timeline(), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
    return told.select("key", "record", F.timestamp_micros("since").alias("valid_from"), F.timestamp_micros("until").alias("valid_to"), "change")


def closed_of(changes: DataFrame) -> DataFrame:
    """The closed versions that hold after all changes so far."""
    keys = ["key", "record", "valid_from", "valid_to"]
    return changes.groupBy(*keys).agg(F.sum("change").alias("n")).where("n > 0").select(*keys)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own, on the same context, whose streams keep state in RocksDB; the given one stays as it is."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    other.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to Parquet files at ``path``, each batch once however often it is run."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def daily(events: DataFrame, time: str, by: list[str], lateness: str | None = None) -> DataFrame:
    """Counts by calendar day, for tables and streams alike."""
    rows = events.withWatermark(time, lateness) if lateness else events
    return rows.groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Runs of events of which each follows within ``gap``: started, ended (the last event and the gap), n."""
    rows = events.withWatermark(time, lateness) if lateness else events
    found = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream through ``sink`` until nothing is left."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
