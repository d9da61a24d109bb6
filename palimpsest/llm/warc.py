"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, then a frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, scratch
from palimpsest.shipping import ship

# Fixed values of the archive formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """A record or frame that breaks the format."""


def file_system(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def name_of(page: Any) -> str:
    """A page's record id; records of pages without an id have one of their own."""
    return f"<urn:uuid:{uuid.uuid4()}>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def record(kind: str, page: Any, url: str | None, payload: bytes, digest: str, first: Any, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: {name_of(page)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {name_of(first)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse(raw: bytes) -> dict[str, Any]:
    """Headers, HTTP length and payload of a record whose headers, lengths and digests hold; else BadArchive."""
    at = raw.find(b"\r\n\r\n")
    if at < 0 or not raw.endswith(b"\r\n\r\n"):
        raise BadArchive("a record without its blank lines")
    version, *lines = raw[:at].decode("utf-8", "strict").split("\r\n")
    if version != VERSION:
        raise BadArchive(f"version {version!r}")
    head: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header line {line!r}")
        head[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-date", "warc-record-id", "content-length"):
        if need not in head:
            raise BadArchive(f"no {need}")
    block = raw[at + 4 : -4]
    if not head["content-length"].isdigit() or int(head["content-length"]) != len(block):
        raise BadArchive("the block's length isn't what its header says")
    if head.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise BadArchive("the block's digest isn't what its header says")
    cut_at = block.find(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", block[: max(cut_at, 0)] + b"\r\n")
    if cut_at < 0 or length is None:
        raise BadArchive("an HTTP header without its length")
    payload = block[cut_at + 4 :]
    if head["warc-type"] == "response":
        if int(length[1]) != len(payload):
            raise BadArchive("the payload's length isn't what its header says")
        if head.get("warc-payload-digest") != "sha1:" + base32_sha1(payload):
            raise BadArchive("the payload's digest isn't what its header says")
    return {"head": head, "http_length": int(length[1]), "payload": payload}


class Writer:
    """One archive. Records go through ``add``; each becomes a frame that states its size."""

    def __init__(self, out: Any, dictionary: bytes, level: int = 3):
        self.out, self.size, self.records = out, 0, 0
        self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.zip.compress(raw))
        self.records += 1


def frames(source: Any, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an open archive, one frame each, read in pieces of ``chunk`` bytes."""
    buffer = source.read(8)
    if len(buffer) < 8 or struct.unpack("<I", buffer[:4])[0] != SKIPPABLE:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack("<I", buffer[4:])[0]
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise BadArchive("the dictionary frame is cut short")
    if dictionary[:4] == FRAME:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    buffer = source.read(chunk)
    while buffer:
        while len(buffer) < 18 and (more := source.read(chunk)):
            buffer += more
        if buffer[:4] != FRAME:
            raise BadArchive("bytes that begin no frame")
        stated = zstandard.get_frame_parameters(buffer).content_size
        frame, parts = unzip.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            if frame.eof:
                buffer = frame.unused_data or source.read(chunk)
                break
            if not (buffer := source.read(chunk)):
                raise BadArchive("the last frame is cut short")
        raw = b"".join(parts)
        if stated not in (zstandard.CONTENTSIZE_UNKNOWN, len(raw)):
            raise BadArchive("the frame's size isn't what it says")
        yield raw


def train(pages: DataFrame, id: str = "page_id", html: str = "html", samples: int = 400, sample_bytes: int = 8192, size: int = 16384) -> bytes:
    """A dictionary from the first ``sample_bytes`` of up to ``samples`` pages, picked by the hash of their id.

    Only compression depends on it. Too few or too small pages give none, an empty frame.
    """
    part = min(1.0, samples / max(1, pages.select(id).count()))
    picked = pages.where(F.pmod(F.xxhash64(id), F.lit(1_000_000)) < int(1_000_000 * part))
    rows = picked.select(F.encode(F.substring(F.coalesce(html, F.lit("")), 1, sample_bytes // 4), "utf-8").alias("b")).limit(samples).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r.b) for r in rows if r.b]).as_bytes()
    except zstandard.ZstdError:
        return b""


#: Payloads that several pages share which are sent to every executor (some 60 bytes each); more are joined in a shuffle.
HELD = 500_000
#: A payload of more than this share of all pages is hot: there are fewer than so many, so these are always sent.
HOT = 200


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, held: int = HELD) -> DataFrame:
    """id, url, html and first: the smallest id among pages with the same payload of at least ``revisit_from`` bytes.

    A null html is an empty payload. A null id never is the smallest. Rows that repeat the smallest id are responses
    themselves. Other columns don't take part. Equal payloads meet as digests in partial aggregates, and pages stay where
    they are: the digests that several share are broadcast. Beyond ``held`` of them only the hot ones are, and the pages of
    the others are shuffled by digest.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "utf-8"))
    large = F.octet_length("html") >= revisit_from
    shared = cut(rows.where(large).groupBy(digest.alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))

    def told(part: DataFrame) -> DataFrame:
        return part.select("id", "url", "html", F.when(large, F.coalesce("first", "id")).alias("first"))

    if shared.count() <= held:
        return told(rows.join(F.broadcast(shared.select("d", "first")), digest == F.col("d"), "left"))
    total = pages.count()
    hot = F.broadcast(shared.where(F.col("n") * HOT > total).select("d", "first"))
    rest = shared.where(F.col("n") * HOT <= total).select(F.col("d").alias("d2"), F.col("first").alias("first2"))
    marked = rows.withColumn("digest", digest).join(hot, F.col("digest") == F.col("d"), "left")
    other = marked.where("d is null").drop("first").join(rest, F.col("digest") == F.col("d2"), "left").withColumnRenamed("first2", "first")
    return told(marked.where("d is not null")).unionByName(told(other))


def write_archives(records: DataFrame, folder: str, dictionary: bytes, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write ``plan_records`` rows as archives of about ``archive_bytes`` each; a row (path, records, bytes) for each.

    The list counts only archives of tasks that succeeded: names are new for every attempt, so a lost executor leaves
    at most files that no list names. The list is cut into the shared folder, so no later job writes again.
    """
    ship(records.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        open_: tuple[Any, str, Writer] | None = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal open_
            out, path, writer = open_
            out.close()
            done.append((path, writer.records, writer.size))
            open_ = None

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if open_ is None:
                    path = f"{top}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path)
                    open_ = (out, path, Writer(out, dictionary))
                payload = html.encode("utf-8", "surrogatepass")
                kind = "response" if first is None or page == first else "revisit"
                open_[2].add(record(kind, page, url, payload, base32_sha1(payload), first, date))
                if open_[2].size >= archive_bytes:
                    close()
        if open_ is not None:
            close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", "records", "bytes"])

    return cut(records.select("id", "url", "html", "first").mapInArrow(work, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, id_type: T.DataType | None = None) -> DataFrame:
    """Every record of the listed archives: id, url, kind, payload_bytes, digest, refers_to and payload (of responses).
    Ids are of ``id_type``, long by default.

    Frames are read one by one; a record that breaks the format, or an archive with another number of records than
    listed, raises BadArchive.
    """
    ship(archives.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("digest", T.StringType()),
            T.StructField("refers_to", T.StringType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def page(urn: str | None) -> str | None:
        found = re.fullmatch(r"<urn:page:([^>]*)>", urn or "")
        return unquote(found[1]) if found else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        store, _ = file_system(folder)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                with store.open_input_stream(path) as source:
                    for raw in frames(source):
                        n += 1
                        found = parse(raw)
                        head, payload = found["head"], found["payload"]
                        kind = head["warc-type"]
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((page(head["warc-record-id"]), head.get("warc-target-uri"), kind, found["http_length"], digest, page(head.get("warc-refers-to")), payload if kind == "response" else None))
                        held += len(payload) + 200
                        if held > 8 << 20:
                            yield flush()
                            held = 0
                if n != records:
                    raise BadArchive(f"{path}: {n} records, {records} were written")
        if rows:
            yield flush()

    found = archives.select("path", "records").mapInArrow(work, schema)
    return found.withColumns({c: F.col(c).cast(id_type or T.LongType()) for c in ("id", "refers_to")})


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return scratch(spark, "warc")
