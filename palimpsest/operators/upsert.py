"""Guarded upserts and other table maintenance without a table format: diffs, then versioned directories."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def differs(columns: Iterable[str], a: str = "t", b: str = "s") -> Column:
    """Whether any column differs between two aliases, nulls equal."""
    found = F.lit(False)
    for c in columns:
        found = found | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return found


def actions(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """The merged table with ``action``: insert, update or keep. One full outer join; staged rows win where they differ.

    Target rows that nothing stages are kept: nothing is ever deleted. Keys must be unique on both sides.
    """
    rest = [c for c in target.columns if c not in keys]
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = staged.select(*target.columns).withColumn("__s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        one = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = one if on is None else on & one
    action = F.when(F.col("__t").isNull(), "insert").when(F.col("__s").isNull(), "keep").when(differs(rest), "update").otherwise("keep")
    # A staged null must win too, so rows are picked by side, not by coalesce.
    from_s = F.col("__s").isNotNull()
    return t.join(s, on, "full_outer").select(*(F.when(from_s, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns), action.alias("action"))


def action_counts(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows an upsert would insert and update."""
    return actions(target, staged, keys).agg(F.count_if(F.col("action") == "insert").alias("inserts"), F.count_if(F.col("action") == "update").alias("updates"))


def upsert(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    return actions(target, staged, keys).drop("action")


def only_new(staged: DataFrame, target: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """Staged rows whose key the target lacks, the first of each key by ``order``: insert if absent. Null keys equal.

    The target's keys meet by a shuffle: Spark estimates them by the size of packed files, and once planned a broadcast
    stays one however many they turn out to be."""
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    first = staged.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    known = target.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct()
    return first.join(known.hint("merge"), _same(keys), "left_anti")


def _same(keys: list[str]) -> Column:
    found = F.lit(True)
    for i, k in enumerate(keys):
        found = found & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return found


def fill_first(target: DataFrame, lookup: DataFrame, key: str, columns: list[str], order: list[Column | str]) -> DataFrame:
    """``target`` with ``columns`` from the first ``lookup`` row of its key where there is one."""
    w = Window.partitionBy(key).orderBy(*order)
    first = lookup.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.col(key).alias("__k"), F.struct(*columns).alias("__v"))
    joined = target.join(first, F.col(key) == F.col("__k"), "left")
    return joined.select(*(F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def without(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Delete where: ``target`` less the keys of ``gone``."""
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def orphans(stored: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the pipeline no longer makes."""
    return stored.join(produced.select(*keys).distinct(), keys, "left_anti")


class VersionedTable:
    """A Parquet table of hashed buckets; a version is a small file that lists each bucket's folders.

    Writers add folders and then a version that names them, so readers see a version whole or not at all, any earlier one
    can be read by number, and a merge rewrites the buckets that change and no others. A version's file is made only if it
    isn't there: of two writers that start from the same version, the later fails and changes nothing.
    """

    #: Buckets of a new table unless others are given, and the stored bytes that one should not pass: a bucket is what a
    #: merge rewrites.
    BUCKETS, BYTES = 64, 1 << 29

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None, bucket_by: list[str] | None = None, buckets: int | None = None):
        self.spark, self.path, self.partition_by, self.bucket_by, self.buckets = spark, path.rstrip("/"), partition_by or [], bucket_by, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm

    def versions(self) -> list[int]:
        fs, folder, _ = self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def _version(self, number: int | None = None) -> tuple[int, dict[str, Any]]:
        known = self.versions()
        if not known or (number is not None and number not in known):
            raise AnalysisException(f"{self.path} has no version {number if number is not None else ''}")
        number = known[-1] if number is None else number
        fs, folder, jvm = self._fs()
        with_ = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{number}.json"))
        try:
            return number, json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()

    def history(self) -> DataFrame:
        """A row for each version: version, committed_at, operation, buckets, summary map<string,string>."""
        found = [(n, *(v[k] for k in ("committed_at", "operation")), len(v["buckets"]), {k: str(x) for k, x in v["summary"].items()}) for n, v in ((n, self._version(n)[1]) for n in self.versions())]
        return self.spark.createDataFrame(found, "version int, committed_at string, operation string, buckets int, summary map<string,string>")

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a version: bucket, file. From the folders' listings; no rows are read."""
        _, body = self._version(version)
        paths = [f"{self.path}/{f}" for folders in body["buckets"].values() for f in folders]
        found = self._scan(T.StructType.fromJson(body["schema"]), paths).inputFiles() if paths else []
        rows = self.spark.createDataFrame([(f,) for f in found], "file string")
        return rows.select(F.regexp_extract("file", "__b=([0-9]+)/", 1).cast("int").alias("bucket"), "file")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The newest version or that of a number; ``buckets`` reads only these."""
        _, body = self._version(version)
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/{f}" for b, folders in body["buckets"].items() if wanted is None or int(b) in wanted for f in folders]
        schema = T.StructType.fromJson(body["schema"])
        return self._scan(schema, paths).select(*schema.names) if paths else self.spark.createDataFrame([], schema)

    def _scan(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        # Writes are partition folders, too, so all of them are one scan.
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def _bucket(self, count: int, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")

    def _put(self, df: DataFrame, keys: list[str], count: int) -> dict[str, list[str]]:
        """Write rows to a new folder; its buckets."""
        name = f"data/__w={uuid.uuid4().hex}"
        out = df.withColumn("__b", self._bucket(count, keys)).hint("rebalance", "__b")
        out.write.option("compression", "zstd").partitionBy("__b", *self.partition_by).parquet(f"{self.path}/{name}")
        fs, _, jvm = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))]
        return {n.removeprefix("__b="): [f"{name}/{n}"] for n in names if n.startswith("__b=")}

    def _commit(self, base: int, operation: str, schema: T.StructType, keys: list[str], count: int, buckets: dict[str, list[str]], summary: dict[str, int]) -> int:
        fs, folder, jvm = self._fs()
        body = {"operation": operation, "committed_at": datetime.now(UTC).isoformat(), "schema": schema.jsonValue(), "keys": keys, "count": count, "buckets": buckets, "summary": summary}
        fs.mkdirs(folder)
        # The whole text first, then its name: a rename fails where the name is taken.
        part, target = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(folder, f"{base + 1}.json")
        out = fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise ConcurrentWrite(f"{self.path}: version {base + 1} was written meanwhile")
        return base + 1

    def _base(self) -> int:
        return (self.versions() or [0])[-1]

    def write(self, df: DataFrame, keys: list[str] | None = None) -> int:
        """Replace the table's rows."""
        keys, base, count = self.bucket_by or keys or df.columns[:1], self._base(), self.buckets or self.BUCKETS
        return self._commit(base, "write", df.schema, keys, count, self._put(df, keys, count), {})

    def wanted_buckets(self) -> int:
        """As many buckets as the newest version has, doubled until none holds more than BYTES on average."""
        _, body = self._version()
        fs, folder, jvm = self._fs()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}") for folders in body["buckets"].values() for f in folders]
        stored, count = sum(fs.getContentSummary(p).getLength() for p in paths), body["count"]
        while stored > count * self.BYTES:
            count *= 2
        return count

    def rebucket(self, count: int | None = None) -> int:
        """A version with the same rows in another number of buckets (by size, if none is given); the version's number."""
        base, body = self._version()
        rows, count = self.read(base), count or self.wanted_buckets()
        if count == body["count"]:
            return base
        return self._commit(base, "rebucket", rows.schema, body["keys"], count, self._put(rows, body["keys"], count), {})

    def _touched(self, staged: DataFrame, keys: list[str], body: dict[str, Any]) -> list[int]:
        """Buckets that staged rows fall into: at most as many as the table has."""
        if missing := set(body["keys"]) - set(keys):
            raise ValueError(f"the table's buckets go by {body['keys']}, and {sorted(missing)} are no keys here")
        return [r[0] for r in staged.select(self._bucket(body["count"], body["keys"]).alias("b")).distinct().collect()]

    def merge(self, staged: DataFrame, keys: list[str]) -> dict[str, int]:
        """Upsert; buckets in which nothing would change aren't written, and if there are no others there's no version."""
        if not self.versions():
            n = staged.count()
            if n:
                self.write(staged, keys)
            return {"inserts": n, "updates": 0}
        base, body = self._version()
        merged = actions(self.read(base, self._touched(staged, keys, body)), staged, keys).withColumn("__b", self._bucket(body["count"], body["keys"])).persist()
        try:
            counts = merged.groupBy("__b").agg(F.count_if(F.col("action") == "insert").alias("i"), F.count_if(F.col("action") == "update").alias("u")).where("i + u > 0").collect()
            done = {"inserts": sum(c.i for c in counts), "updates": sum(c.u for c in counts)}
            if counts:
                new = self._put(merged.where(F.col("__b").isin([c["__b"] for c in counts])).drop("action", "__b"), body["keys"], body["count"])
                self._commit(base, "merge", T.StructType.fromJson(body["schema"]), body["keys"], body["count"], body["buckets"] | new, done | {"buckets_written": len(new)})
            return done
        finally:
            merged.unpersist()

    def append_new(self, staged: DataFrame, keys: list[str]) -> int:
        """Add the staged rows whose key isn't there; what is there isn't written again. How many."""
        if not self.versions():
            first = only_new(staged, staged.limit(0), keys)
            n = first.count()
            if n:
                self.write(first, keys)
            return n
        base, body = self._version()
        there = self.read(base, self._touched(staged, keys, body))
        fresh = only_new(staged.select(*there.columns), there, keys).persist()
        try:
            n = fresh.count()
            if n:
                new, old = self._put(fresh, body["keys"], body["count"]), body["buckets"]
                self._commit(base, "append", T.StructType.fromJson(body["schema"]), body["keys"], body["count"], old | {b: old.get(b, []) + f for b, f in new.items()}, {"inserts": n})
            return n
        finally:
            fresh.unpersist()

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets in which rows with these keys lie."""
        _, body = self._version()
        return self._touched(rows, rows.columns, body)


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version that this one was to be."""


def statements(ddl: str) -> list[str]:
    """Statements between semicolons; those inside quotes, back-quotes and comments part nothing."""
    token = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S)
    parts = [""]
    for piece in token.findall(ddl):
        if piece == ";":
            parts.append("")
        elif not piece.startswith(("--", "/*")):
            parts[-1] += piece
    return [p.strip() for p in parts if p.strip()]


def apply_ddl(spark: SparkSession, ddl: str) -> int:
    """Run statements separated by semicolons; how many ran."""
    found = statements(ddl)
    for statement in found:
        spark.sql(statement)
    return len(found)
