"""Op 10: round trips and what a reader must refuse."""

import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from palimpsest.llm import warc


def archive(records, dictionary=b""):
    out = io.BytesIO()
    writer = warc.Writer(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def sample(n, payload=b"<p>hi</p>"):
    return warc.record("response", n, f"http://x/{n}", payload, warc.base32_sha1(payload), n, "2024-01-01T00:00:00Z")


def test_frames_and_dictionary():
    pages = [b"<html><body><p>page number %d of the same site</p></body></html>" % i * 5 for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, pages).as_bytes()
    records = [sample(i, p) for i, p in enumerate(pages)] + [sample(999, b""), sample(1000, b"x" * 700_000)]
    for held in (dictionary, b"", zstandard.ZstdCompressor().compress(dictionary)):
        if held and held[:4] == warc.FRAME:
            raw = archive(records, dictionary)
            raw = struct.pack("<II", warc.SKIPPABLE, len(held)) + held + raw[8 + len(dictionary) :]
        else:
            raw = archive(records, held)
        for chunk in (7, 1000, 1 << 20):
            if chunk > 7 or not held:
                assert list(warc.frames(io.BytesIO(raw), chunk)) == records
    assert warc.parse(records[3])["payload"] == pages[3]


def test_broken_archives():
    good = archive([sample(1), sample(2)])
    for bad in (good[8:], b"", good[:-3], good + b"junk and more", good[:4] + struct.pack("<I", 10**6) + good[8:]):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(io.BytesIO(bad)))
    flipped = bytearray(good)
    flipped[-8] ^= 255
    with pytest.raises(warc.BadArchive):
        list(warc.frames(io.BytesIO(bytes(flipped))))


def test_broken_records():
    good = sample(1)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"<p>hi", b"<p>ho"), good.replace(b"hi</p>", b"hi!</p>"), b"x"):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", warc.F.lit("clash"))
    folder = warc.archive_folder(spark)
    written = warc.write_archives(warc.plan_records(df, **options), folder, warc.train(df), archive_bytes=3000)
    return written, sorted(((r.id, r.url, r.kind, r.payload_bytes, r.refers_to, bytes(r.payload).decode() if r.payload is not None else None) for r in warc.read_archives(written, folder).collect()), key=str)


def test_round_trip(spark):
    rows = [(5, "http://a/ b\r\n", "same é"), (3, None, "same é"), (9, "u", "same é"), (1, "u", None), (2, "u", ""), (7, "u", "z" * 90000), (None, "n", "same é"), (4, "u", "own"), (4, "u", "own")]
    written, found = run(spark, rows)
    want = [
        (5, "http://a/%20b%0D%0A", "revisit", 7, 3, None), (3, None, "response", 7, None, "same é"), (9, "u", "revisit", 7, 3, None), (1, "u", "response", 0, None, ""), (2, "u", "revisit", 0, 1, None),
        (7, "u", "response", 90000, None, "z" * 90000), (None, "n", "revisit", 7, 3, None), (4, "u", "response", 3, None, "own"), (4, "u", "response", 3, None, "own"),
    ]
    assert found == sorted(want, key=str)
    assert sum(r.records for r in written.collect()) == 9


def test_small_payloads_are_all_responses(spark):
    _, found = run(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], revisit_from=4)
    assert [r[2] for r in found] == ["response", "response", "response", "revisit"]


def test_nothing(spark):
    assert run(spark, [])[1] == []


def test_shared_payloads_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [(n, "u", ["", None, f"<p>{n % 7}</p>", f"<p>own {n}</p>"][n % 4]) for n in range(120)] + [(None, "u", "<p>3</p>"), (5, "u", "<p>own</p>"), (5, "u", "<p>own</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    want = {}
    for i, _, h in rows:
        if i is not None:
            want[h or ""] = min(i, want.get(h or "", i))
    expected = sorted(((i, h or "", want[h or ""]) for i, _, h in rows), key=str)
    monkeypatch.setattr(warc, "HOT", 10)
    for held in (warc.HELD, 0):
        found = warc.plan_records(df, held=held).collect()
        assert sorted(((r.id, r.html, r.first) for r in found), key=str) == expected
    assert warc.plan_records(df.limit(0), held=-1).count() == 0


def test_ids_of_any_type(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("a b>c", "u", "x"), ("é", "u", "x"), (None, "u", "own"), (None, "u", "own2")], "page_id string, url string, html string")
    folder = warc.archive_folder(spark)
    written = warc.write_archives(warc.plan_records(df), folder, b"")
    found = warc.read_archives(written, folder, T.StringType()).select("id", "kind", "refers_to", "payload").collect()
    got = {(r.id, r.kind, r.refers_to, r.payload and bytes(r.payload)) for r in found}
    assert got == {("a b>c", "response", None, b"x"), ("é", "revisit", "a b>c", None), (None, "response", None, b"own"), (None, "response", None, b"own2")}
