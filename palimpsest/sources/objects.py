"""Content-addressed JSON objects: scans, schema-tolerant columns, put-if-absent, manifests; other file sources."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from palimpsest.functions.identity import space_of
from palimpsest.schemas import PROPOSAL, TOPIC
from palimpsest.shipping import ship

# The protocols, their spaces and forums.
PROTOCOLS = [
    ("aave", "aavedao.eth", "governance.aave.com", "Aave"),
    ("uniswap", "uniswapgovernance.eth", "gov.uniswap.org", "Uniswap"),
    ("arbitrum", "arbitrumfoundation.eth", "forum.arbitrum.foundation", "Arbitrum"),
    ("optimism", "opcollective.eth", "gov.optimism.io", "Optimism"),
    ("ens", "ens.eth", "discuss.ens.domains", "ENS"),
]


def protocols(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The protocol dimension, five rows; unknown names are an error."""
    known = {p[0] for p in PROTOCOLS}
    if unknown := sorted(set(names or []) - known):
        raise KeyError(f"unknown protocol(s): {unknown}; known: {sorted(known)}")
    rows = [p for p in PROTOCOLS if not names or p[0] in names]
    return spark.createDataFrame(rows, "protocol_name string, snapshot_space string, discourse_host string, display string")


#: Levels of folders below a path whose entries are dealt out again before they are opened, and what a batch holds.
LEVELS, ENTRIES, CHARS = 2, 4096, 1 << 20
#: What Java leaves as it is in a URI's path, besides letters, digits and all that isn't ASCII.
PLAIN = "/_-!.~'()*,;:$&+=@"
FOUND = "store string, path string, folder boolean, length long, modified long"


def _encoded(path: str) -> str:
    return re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe=PLAIN), path)


def _store(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI as Java writes it, and the path there."""
    return FileSystem.from_uri(re.sub(r"[^\x00-\x7f]+", lambda m: quote(m[0]), re.sub(r"^file:/+", "file:///", uri)))


def _roots(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str, bool, int, int]] | None:
    """The files and folders that paths or patterns name, as rows of FOUND; none if Spark alone knows their store."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for one in [path] if isinstance(path, str) else path:
        place = jvm.org.apache.hadoop.fs.Path(one)
        hits = place.getFileSystem(conf).globStatus(place)
        if not hits:
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {one}")
        for hit in hits:
            uri = re.sub(r"^file:/+", "file:/", hit.getPath().toUri().toString())  # as Spark names files
            try:
                _, own = _store(uri)
            except (pa.ArrowException, OSError):
                return None
            if not uri.endswith(_encoded(own)):
                return None
            found.append((uri.removesuffix(_encoded(own)), own, hit.isDirectory(), hit.getLen(), hit.getModificationTime()))
    return found


def _opened(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders as their entries, without hidden ones, down to the files if ``deep``; files stay."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["store", "path", "folder", "length", "modified"])

    def entries(store: str, path: str) -> Iterator[tuple]:
        fs, _ = _store(store + _encoded(path))
        for one in fs.get_file_info(FileSelector(path)):
            name = one.base_name
            if not ((name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")):
                folder = one.type == FileType.Directory
                yield store, one.path, folder, 0 if folder else one.size, one.mtime_ns // 1_000_000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[2]:
                    out.append(row)
                waiting = [row] if row[2] else []
                while waiting:
                    top = waiting.pop()
                    for one in entries(top[0], top[1]):
                        (waiting if deep and one[2] else out).append(one)
                        if len(out) >= ENTRIES:
                            yield made(out)
                            out = []
        if out:
            yield made(out)

    return work


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """The files under ``path`` as rows of FOUND (store and path together are the URI, modified is in milliseconds), or
    None if only Spark knows the store.

    Executors list the folders: the entries of the upper levels are dealt out before they are opened, so the driver holds
    only what ``path`` names, however many objects there are.
    """
    roots = _roots(spark, path)
    if roots is None:
        return None
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(roots, FOUND)
    for _ in range(LEVELS):
        rows = rows.mapInArrow(_opened(deep=False), FOUND).repartition(parts, "path")
    return rows.mapInArrow(_opened(deep=True), FOUND)


def _texts(files: DataFrame, whole: bool) -> DataFrame:
    """The lines of listed files, or each file's text, with source_key and observed_at; what is packed is unpacked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for store, path, modified in zip(*(batch.column(c).to_pylist() for c in ("store", "path", "modified")), strict=True):
                uri = store + _encoded(path)
                fs, own = _store(uri)
                with fs.open_input_stream(own) as given, io.TextIOWrapper(given, "utf-8" if whole else "utf-8-sig", "replace", "" if whole else None) as text:
                    for line in [text.read()] if whole else text:
                        out.append((line if whole else line.removesuffix("\n"), uri, modified))
                        held += len(line)
                        if held >= CHARS or len(out) >= ENTRIES:
                            yield made(out)
                            out, held = [], 0
            if out:
                yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64()], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["value", "source_key", "modified"])

    found = files.mapInArrow(work, "value string, source_key string, modified long")
    return found.select("value", "source_key", F.timestamp_millis("modified").alias("observed_at"))


def scan_json(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Every JSON object under ``path`` with source_key, its path, and observed_at, its file time; no schema inference.

    Executors list and read the files (Spark's reader would bring every file's name to the driver); where the store is
    one that only Spark knows, Spark's reader does it.
    """
    files = listed(spark, path)
    if files is None:
        raw = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
        return raw.select("*", F.col("_metadata.file_path").alias("source_key"), F.col("_metadata.file_modification_time").alias("observed_at"))
    lines = _texts(files, whole=False).where(F.trim("value", F.lit(" \t")) != "")
    # A line may hold one object, or a list of them.
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(schema)))
    rows = lines.select(F.explode(F.coalesce(many, F.array(F.from_json("value", schema)))).alias("o"), "source_key", "observed_at")
    return rows.select("o.*", "source_key", "observed_at")


def scan_proposals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return scan_json(spark, path, PROPOSAL).withColumn("space_key", space_of(F.col("source_key")))


def scan_topics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return scan_json(spark, path, TOPIC).withColumn("forum_host", space_of(F.col("source_key")))


def scan_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole objects as text with their path and time, for hashing and untyped access."""
    files = listed(spark, path)
    if files is not None:
        return _texts(files.where("length > 0"), whole=True).withColumnRenamed("value", "payload")
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_key"), F.col("_metadata.file_modification_time").alias("observed_at"))


def query_files(spark: SparkSession, path: str, columns: str = "*", kind: str = "json") -> DataFrame:
    """SQL straight over files. The path is quoted; ``kind`` is a format's name."""
    if not kind.isidentifier():
        raise ValueError(f"no format: {kind!r}")
    quoted = path.replace("`", "``")
    return spark.sql(f"select {columns} from {kind}.`{quoted}`")


def map_value(entries: Column, key: str) -> Column:
    """A value of a map by its key, null where the map or the key is missing: such as a snapshot summary's counters."""
    return F.try_element_at(entries, F.lit(key))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or a typed null where the frame has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def optional_field(df: DataFrame, struct: str, field: str, kind: str = "string") -> Column:
    """A struct's field, or a typed null where struct or field is missing."""
    top = df.schema[struct].dataType if struct in df.columns else None
    return F.col(f"{struct}.{field}") if isinstance(top, T.StructType) and field in top.names else F.lit(None).cast(kind).alias(field)


def ensure_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """``df`` with every wanted column, typed nulls for those it lacks."""
    missing = [f for f in wanted.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def put_if_absent(objects: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """Objects whose key isn't known yet, one of each key."""
    return objects.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def write_objects(objects: DataFrame, path: str, key: str = "key", payload: str = "payload") -> dict[str, int]:
    """Put each JSON text at ``path``/its key unless an object is there; counts of written, skipped and errors.

    Executors ask for each key by itself, so neither listings nor stored payloads are read, and put what is new under
    another name first and then move it: a task that is lost and run again finds what it has written. Rows that repeat a
    key are one object and skipped rows; those of a null key or payload are errors, as are objects that can't be written.
    """
    ship(objects.sparkSession)
    top = path.rstrip("/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, base = FileSystem.from_uri(top if "://" in top else f"file://{os.path.abspath(top)}")
            said = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if name is None or text is None:
                        raise ValueError("nothing to put")
                    target = f"{base}/{name}"
                    if fs.get_file_info(target).type != FileType.NotFound:
                        said.append("skipped")
                        continue
                    folder, _, last = target.rpartition("/")
                    fs.create_dir(folder, recursive=True)
                    part = f"{folder}/_{last}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as out:
                        out.write(text.encode("utf-8", "replace"))
                    fs.move(part, target)
                    said.append("written")
                except (OSError, ValueError):
                    said.append("errors")
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["what"])

    rows = objects.select(F.col(key).alias("key"), F.col(payload).alias("payload"))
    seen = Observation()
    one = rows.observe(seen, F.count("*").alias("n")).groupBy("key").agg(F.min("payload").alias("payload"), F.count("*").alias("n"))
    again = Observation()
    done = one.observe(again, F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1)).alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n") - 1)).alias("null"))
    found = {r.what: r["count"] for r in done.select("key", "payload").mapInArrow(work, "what string").groupBy("what").count().collect()}
    repeats = again.get
    return {
        "written": found.get("written", 0),
        "skipped": found.get("skipped", 0) + (repeats["n"] or 0),
        "errors": found.get("errors", 0) + (repeats["null"] or 0),
    }


def write_manifest(spark: SparkSession, path: str, run: str, body: dict[str, Any]) -> str:
    """A run's report as one JSON file, apart from the objects."""
    target = f"{path.rstrip('/')}/_manifests/{run}.json"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps({"run_id": run, **body}, indent=2).encode()))
    finally:
        out.close()
    return target


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(f"{path.rstrip('/')}/_manifests")


# Fixed value: the line that opens a table's block in a dump.
COPY_HEADER = r"^COPY\s+(\S+)\s+\(([^)]+)\)\s+FROM\s+stdin;\s*$"


#: Where a line of a dump stands: in no block, in the wanted one, in another, or after the wanted one.
OUT, IN, ELSEWHERE, OVER = range(4)


def _moves(state: int, line: str, header: re.Pattern[str], table: str | None) -> int:
    """The state after a line that may open or end a block. Inside a block, what looks like a header is a row."""
    if state in (IN, ELSEWHERE):
        return (OVER if state == IN and table is None else OUT) if line == "\\." else state
    if state == OUT and (hit := header.match(line)):
        return IN if table is None or table in (hit[1], hit[1].rpartition(".")[2]) else ELSEWHERE
    return state


def copy_lines(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The rows' lines of one COPY block, read by as many tasks as the dump has splits.

    Whether a line lies in the block depends on all lines before it, but what a split does to that state depends on its
    own lines alone: a first pass sums up, for each split that holds the head or end of a block, where it leads from each
    state. Going through these in the order of files and places (a row for each such split reaches the driver) gives every
    split the state it begins in, and a second pass keeps the lines.
    """
    ship(spark)
    header = re.compile(COPY_HEADER)
    where = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", *(F.col(c).alias(n) for c, n in zip(where, ("file", "start"), strict=True)))

    def turns(files: pa.Array, starts: pa.Array) -> Iterator[tuple[int, int, tuple[str, int]]]:
        keys = list(zip(files.to_pylist(), starts.to_pylist(), strict=True))
        a = 0
        for b in range(1, len(keys) + 1):
            if b == len(keys) or keys[b] != keys[a]:
                yield a, b, keys[a]
                a = b

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b, key in turns(batch.column(1), batch.column(2)):
                to = found.setdefault(key, [OUT, IN, ELSEWHERE, OVER])
                for line in texts[a:b]:
                    to[:] = [_moves(state, line, header, table) for state in to]
        if found:
            columns = [pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "to"])

    telling = lines.where((F.col("value") == "\\.") | F.col("value").startswith("COPY"))
    known = telling.mapInArrow(leads, "file string, start long, to array<int>").orderBy("file", "start").collect()
    begins, state = [], OUT
    for r in known:
        begins.append((r.file, r.start, state))
        state = r.to[state]
    # A split without such lines begins, and ends, in the state that the last one before it has left.
    after = [(f, s, begin, r.to[begin]) for (f, s, begin), r in zip(begins, known, strict=True)]
    held = spark.sparkContext.broadcast(after)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [(f, s) for f, s, _, _ in held.value]
        at, state = None, OUT
        for batch in batches:
            for a, b, key in turns(batch.column(1), batch.column(2)):
                if key != at:
                    n = bisect_left(order, key)
                    own = n < len(order) and order[n] == key
                    at, state = key, held.value[n][2] if own else held.value[n - 1][3] if n else OUT
                texts = batch.column(0).slice(a, b - a)
                marks = pc.or_(pc.equal(texts, "\\."), pc.starts_with(texts, "COPY"))
                edge = 0
                for i in [*pc.indices_nonzero(marks).to_pylist(), len(texts)]:
                    if state == IN and i > edge:
                        yield pa.RecordBatch.from_arrays([texts.slice(edge, i - edge)], names=["value"])
                    if i < len(texts):
                        line = texts[i].as_py()
                        now = _moves(state, line, header, table)
                        if state == now == IN:  # a row that only looks like a header
                            yield pa.RecordBatch.from_arrays([texts.slice(i, 1)], names=["value"])
                        state = now
                    edge = i + 1

    return lines.mapInArrow(keep, "value string")


def read_copy(spark: SparkSession, path: str, schema: str, table: str | None = None) -> DataFrame:
    """Rows of one COPY block of a (gzipped) SQL dump: tab-separated, ``\\N`` null, backslash escapes, ended by ``\\.``.

    The block is that of ``table`` (with or without its schema's name; several blocks of it are taken together), or the
    first. A plain file is read in splits, a gzipped one in one; files are in the order of their names. A row with another
    number of fields than ``schema`` is an error.
    """
    fields = T._parse_datatype_string(schema).fields
    parts = F.split("value", "\t", -1)
    wrong = F.raise_error(F.format_string(f"a row of %d fields, not {len(fields)}", F.size("p")))
    rows = copy_lines(spark, path, table).select(parts.alias("p")).select(F.when(F.size("p") == len(fields), F.col("p")).otherwise(wrong).alias("p"))

    def plain(c: Column) -> Column:
        text = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
        for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v")):
            text = F.replace(text, F.lit(mark), F.lit(char))
        return F.when(c != "\\N", F.replace(text, F.lit("\u0001"), F.lit("\\")))

    return rows.select(*(plain(F.get("p", F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


#: Where a copy notes what it has done, and the bytes that are held at once.
RESTORED, PIECE = "_restored", 1 << 20


def restore(spark: SparkSession, source: str, target: str, suffixes: Iterable[str] = (".json",)) -> dict[str, int]:
    """Copy objects with one of the suffixes, keeping their places; counts of copied, skipped and errors.

    Executors list the files, and copy each in pieces under another name and then move it, so a task that is lost and
    run again finds whole objects or none. What was copied is noted in the target's ``_restored`` folder: a later call
    leaves out what is noted with the same length, and asks for the others one by one.
    """
    ship(spark)
    files = listed(spark, source)
    if files is None:
        raise ValueError(f"executors can't read {source}")
    top = _store(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source).toUri().toString() if "://" in source else f"file:///{_encoded(os.path.abspath(source)).lstrip('/')}")[1].rstrip("/")
    asked = reduce(lambda a, b: a | b, (F.col("path").endswith(s) for s in suffixes), F.lit(False))
    wanted = files.where(asked).select("store", "path", "length", F.substring("path", F.lit(len(top) + 2), F.length("path")).alias("name"))
    jvm = spark.sparkContext._jvm
    notes = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{RESTORED}")
    noted = notes.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(notes)
    kind = "name string, length long, what string"
    if noted:
        before = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(notes.toString()).where("what <> 'errors'").select("name", "length").distinct()
        done = wanted.join(before, ["name", "length"], "left_semi").count()
        wanted = wanted.join(before, ["name", "length"], "left_anti")
    else:
        done = 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = FileSystem.from_uri(target if "://" in target else f"file://{os.path.abspath(target)}")
        for batch in batches:
            said = []
            for store, path, length, name in zip(*(batch.column(c).to_pylist() for c in ("store", "path", "length", "name")), strict=True):
                try:
                    fs, own = _store(store + _encoded(path))
                    goal = f"{base}/{name}"
                    there = to.get_file_info(goal)
                    if there.type == FileType.File and there.size == length:
                        said.append("skipped")
                        continue
                    folder, _, last = goal.rpartition("/")
                    to.create_dir(folder, recursive=True)
                    part = f"{folder}/_{last}.{uuid.uuid4().hex}"
                    with fs.open_input_stream(own) as given, to.open_output_stream(part) as out:
                        while piece := given.read(PIECE):
                            out.write(piece)
                    to.move(part, goal)
                    said.append("copied")
                except OSError:
                    said.append("errors")
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("length"), pa.array(said, pa.string())], names=["name", "length", "what"])

    run = f"{notes.toString()}/run-{uuid.uuid4().hex}"
    wanted.select("store", "path", "length", "name").mapInArrow(work, kind).write.parquet(run)
    found = {r.what: r["count"] for r in spark.read.schema(kind).parquet(run).groupBy("what").count().collect()}
    return {"copied": found.get("copied", 0), "skipped": found.get("skipped", 0) + done, "errors": found.get("errors", 0)}
