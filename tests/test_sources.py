"""Scans, tolerant columns, object writes, dumps, paged sources."""

import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.sources import objects, paged


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def test_scan_with_missing_keys(spark, tmp_path):
    write(tmp_path / "space=aavedao.eth/1/a.json", {"id": "0x1", "title": "t", "scores": [1, 2.5], "quorum": 3})
    write(tmp_path / "space=ens.eth/2/b.json", {"id": "0x2", "unknown": 1})
    found = {r.id: r for r in objects.scan_proposals(spark, str(tmp_path)).collect()}
    assert (found["0x1"].space_key, found["0x1"].scores, found["0x1"].quorum, found["0x1"].discussion) == ("aavedao.eth", [1.0, 2.5], 3.0, None)
    assert found["0x2"].space_key == "ens.eth" and found["0x2"].observed_at is not None
    assert objects.query_files(spark, f"{tmp_path}/space=ens.eth/2", "id").first()[0] == "0x2"


def test_a_scan_is_listed_by_executors_and_reads_what_sparks_reader_does(spark, tmp_path):
    top = tmp_path / "o é %"
    texts = {"space=a/1/x.json": '{"id": "1"}\n\n[{"id": "2"}, {"id": "3", "votes": 4}]\r\n{broken', "b.json": '\ufeff{"id": "4"}', "space=c d/_e=1/f/g/h/é+#[1].json": '{"id": "5", "title": "ö"}', "_hidden/a.json": "{}", "space=a/.b.json": "{}", "empty.json": ""}
    for name, text in texts.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(text.encode())
    with gzip.open(top / "z.json.gz", "wt") as f:
        f.write('{"id": "6"}\n{"id": "7"}\n')
    for place in (str(top), f"{top}/space=*", [f"{top}/b.json", f"{top}/space=a"]):
        raw = spark.read.schema(schemas.PROPOSAL).option("recursiveFileLookup", "true").json(place)
        want = raw.select("id", "title", "votes", F.col("_metadata.file_path").alias("source_key"), F.col("_metadata.file_modification_time").alias("observed_at"))
        made = objects.scan_json(spark, place, schemas.PROPOSAL)
        assert sorted(map(repr, made.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert made.inputFiles() == []  # no file is known to the driver
    whole = spark.read.option("recursiveFileLookup", "true").text(str(top), wholetext=True).collect()
    assert sorted(r.payload for r in objects.scan_json_text(spark, str(top)).collect()) == sorted(r.value for r in whole)
    with pytest.raises(AnalysisException):
        objects.scan_json(spark, f"{tmp_path}/nowhere", schemas.PROPOSAL)


def test_tolerant_columns(spark):
    df = spark.createDataFrame([(1, (2,))], "a int, s struct<x:int>")
    row = df.select(objects.optional(df, "a"), objects.optional(df, "b", "double"), objects.optional_field(df, "s", "x"), objects.optional_field(df, "s", "y", "int"), objects.optional_field(df, "z", "y"))
    assert row.dtypes[1] == ("b", "double") and tuple(row.first()) == (1, None, 2, None, None)
    whole = objects.ensure_columns(df, schemas.FORUM_POSTS)
    assert set(schemas.FORUM_POSTS.names) < set(whole.columns) and whole.first().post_id is None
    assert objects.empty(spark, schemas.TOPIC).count() == 0


def test_protocols(spark):
    assert objects.protocols(spark).count() == 5
    assert [r.display for r in objects.protocols(spark, ["ens"]).collect()] == ["ENS"]
    with pytest.raises(KeyError):
        objects.protocols(spark, ["nobody"])


def test_writes_are_put_if_absent(spark, tmp_path):
    rows = [("snapshot/space=ens.eth/0x1/k1.json", '{"id": "0x1"}')] * 2 + [("snapshot/space=ens.eth/0x2/k2.json", '{"id": "0x2", "title": "é"}')]
    df = spark.createDataFrame(rows, "key string, payload string")
    top = str(tmp_path / "o")
    assert objects.write_objects(df, top) == {"written": 2, "skipped": 1, "errors": 0}
    assert objects.write_objects(df, top) == {"written": 0, "skipped": 3, "errors": 0}
    odd = spark.createDataFrame([(None, "{}"), (None, "{}"), ("a/b.json", None), ("snapshot/space=ens.eth/0x1/k1.json/under", "{}")], "key string, payload string")
    assert objects.write_objects(odd, top) == {"written": 0, "skipped": 0, "errors": 4}
    # What was put is what a scan reads.
    found = {(r.id, r.title, r.space_key, r.source_key.rpartition("/")[2]) for r in objects.scan_proposals(spark, f"{top}/snapshot").collect()}
    assert found == {("0x1", None, "ens.eth", "k1.json"), ("0x2", "é", "ens.eth", "k2.json")}
    path = objects.write_manifest(spark, str(tmp_path), "r1", {"written": 2})
    assert path.endswith("_manifests/r1.json")
    assert objects.read_manifests(spark, str(tmp_path), "run_id string, written int").first().written == 2


def test_copy_block(spark, tmp_path):
    dump = "SET x;\nCOPY t (a, b, c) FROM stdin;\n1\tx\\ty\\\\n\t\\N\n2\t\t3.5\n\\.\nSELECT 1;\nCOPY public.u (a, b, c) FROM stdin;\n7\tu\t1\n\\.\n"
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write(dump)
    read = lambda table: sorted(map(tuple, objects.read_copy(spark, str(tmp_path / "d.sql.gz"), "a int, b string, c double", table).collect()))
    assert read(None) == read("t") == [(1, "x\ty\\n", None), (2, "", 3.5)]
    assert read("u") == read("public.u") == [(7, "u", 1.0)]
    assert read("nobody") == []
    with pytest.raises(Exception, match="fields"):
        objects.read_copy(spark, str(tmp_path / "d.sql.gz"), "a int, b string").collect()


def test_paths_are_quoted(spark, tmp_path):
    write(tmp_path / "odd`name/a.json", {"id": "x"})
    assert objects.query_files(spark, f"{tmp_path}/odd`name", "id").first()[0] == "x"
    with pytest.raises(ValueError):
        objects.query_files(spark, "p", "id", "json`.x")


def test_restore(spark, tmp_path):
    write(tmp_path / "a/x/1.json", {})
    write(tmp_path / "a/2.txt", {})
    assert objects.restore(spark, str(tmp_path / "a"), str(tmp_path / "b"))["copied"] == 1
    assert (tmp_path / "b/x/1.json").exists()


def test_the_driver_lists_no_objects_for_a_copy(spark, tmp_path, monkeypatch):
    for n in range(3):
        write(tmp_path / f"o é/x{n}/{n}.json", {})

    def refused(self, *_, **__):
        raise AssertionError("a reader that lists on the driver")

    from pyspark.sql import DataFrameReader

    kind = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, name: refused(self) if name == "binaryFile" else kind(self, name))
    assert objects.restore(spark, str(tmp_path / "o é"), str(tmp_path / "b")) == {"copied": 3, "skipped": 0, "errors": 0}
    assert (tmp_path / "b/x2/2.json").exists()


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = paged.RateLimit(60, clock=lambda: now[0], sleep=sleep)
    for _ in range(12):
        limit.acquire()
    assert limit.burst == 10 and len(slept) == 2 and abs(sum(slept) - 2) < 1e-9
    with pytest.raises(ValueError):
        paged.RateLimit(0)


@pytest.mark.parametrize(("answers", "calls", "ok"), [([200], 1, True), ([429, 503, 200], 3, True), ([404], 1, False), ([500] * 5, 5, False), ([OSError(), 200], 2, True)])
def test_retries(answers, calls, ok):
    seen, slept = [], []

    def transport(method, url, params):
        seen.append(url)
        a = answers[len(seen) - 1]
        if isinstance(a, OSError):
            raise a
        return a, {"Retry-After": "7"} if a == 429 else {}, "body"

    run = lambda: paged.request(transport, "GET", "u", {}, sleep=slept.append, jitter=lambda: 0.0)
    if ok:
        assert run() == "body"
    else:
        with pytest.raises(paged.SourceError):
            run()
    assert len(seen) == calls
    if answers[0] == 429:
        assert slept == [7.0, 2.0]


def test_pages():
    items = [{"id": str(i), "created": 100 - i} for i in range(23)]
    asked = []

    def fetch(n, before):
        asked.append(n)
        return [x for x in items if before is None or x["created"] < before][:n]

    assert [x["id"] for x in paged.cursor_pages(fetch, 12, 5)] == [str(i) for i in range(12)] and asked == [5, 5, 2]
    assert len(list(paged.cursor_pages(fetch, 100, 10))) == 23
    assert len(list(paged.cursor_pages(lambda n, b: items[:5], 100, 5))) == 5  # the cursor stalls
    pages = [[{"id": 1}, {"id": 2}], [{"id": 2}, {"id": 3}], [{"id": 3}], [{"id": 9}]]
    assert [x["id"] for x in paged.numbered_pages(lambda n: pages[n])] == [1, 2, 3]
    assert [x["id"] for x in paged.numbered_pages(lambda n: pages[n], limit=2)] == [1, 2]
    with pytest.raises(paged.SourceError):
        paged.graph_query(lambda q: {"errors": ["no"]}, "q", {})


def api(calls):
    """A transport that plays both APIs: five proposals of each space, a listing and topics with posts."""

    def call(method, url, params):
        calls.append((method, url, params))
        if url.endswith("/graphql"):
            v = params["variables"]
            if "id" in v:
                return 200, {}, {"data": {"space": {"id": v["id"], "name": "N"} if v["id"] == "ens.eth" else None}}
            rows = [{"id": f"{v['space']}-{n}", "title": f"t{n}", "body": "b", "created": 100 - n, "space": {"id": v["space"]}} for n in range(5)]
            return 200, {}, {"data": {"proposals": [r for r in rows if v["createdLt"] is None or r["created"] < v["createdLt"]][: v["first"]]}}
        if url.endswith("/latest.json"):
            return 200, {}, {"topic_list": {"topics": [{"id": 10 * params["page"] + n, "title": "x"} for n in range(3)] if params["page"] < 2 else []}}
        topic = int(url.rpartition("/")[2].removesuffix(".json"))
        return 200, {}, {"id": topic, "title": "x", "views": len(calls), "post_stream": {"posts": [{"id": topic * 10, "cooked": f"<p>{topic}</p>", "reads": len(calls)}]}}

    return call


def test_clients():
    calls = []
    client = paged.ProposalClient(api(calls), sleep=lambda s: None)
    assert client.space("ens.eth") == {"id": "ens.eth", "name": "N"} and client.space("nobody") is None
    assert [p["id"] for p in client.proposals("ens.eth", 4, 2)] == [f"ens.eth-{n}" for n in range(4)]
    assert [c[2]["variables"].get("createdLt") for c in calls[2:]] == [None, 99]
    assert "proposals(" in calls[-1][2]["query"] and calls[-1][:2] == ("POST", paged.PROPOSALS_URL)
    calls.clear()
    forum = paged.ForumClient("https://f.org/", api(calls), sleep=lambda s: None)
    assert [t["id"] for t in forum.topics(5)] == [0, 1, 2, 10, 11] and [c[1] for c in calls] == ["https://f.org/latest.json"] * 2
    assert [t["post_stream"]["posts"][0]["id"] for t in forum.with_posts(2)] == [0, 10]
    assert client.limit.held < client.limit.burst and forum.limit.held < forum.limit.burst  # every call took a token
    with pytest.raises(paged.SourceError):
        paged.ProposalClient(lambda *a: (200, {}, {"errors": ["no"]})).space("x")


def test_waits_are_bounded_and_dates_count_as_none():
    slept, answers = [], iter([(503, {"Retry-After": "Wed, 21 Oct 2026 07:28:00 GMT"}), (429, {"retry-after": "999"}), (502, {}), (200, {})])
    paged.request(lambda *a: (*next(answers), "x"), "GET", "u", {}, sleep=slept.append, jitter=lambda: 0.0)
    assert slept == [1.0, 60.0, 4.0]
    with pytest.raises(paged.SourceError):
        paged.request(lambda *a: (501, {}, ""), "GET", "u", {}, sleep=slept.append)


def test_listed_topics_get_their_posts(spark):
    listed = spark.createDataFrame([("f.org", 3), ("g.org", 4)], "forum_host string, topic_id long")
    found = {r.topic_id: json.loads(r.payload)["post_stream"]["posts"][0]["id"] for r in paged.with_details(listed, api([])).collect()}
    assert found == {3: 30, 4: 40}


def test_sql_rows(spark):
    assert paged.sql_rows(spark, "select id, :x as x from range(3) where id > :least order by id", least=0, x="q") == [{"id": 1, "x": "q"}, {"id": 2, "x": "q"}]


def test_map_values(spark):
    df = spark.sql("select map('total-records', '7') m union all select map() union all select null")
    assert sorted((r[0] for r in df.select(objects.map_value(F.col("m"), "total-records")).collect()), key=str) == ["7", None, None]


def test_paged_source(spark):
    def fetch(space):
        yield {"id": f"{space}-1", "title": "t", "created": 5}
        yield {"id": f"{space}-2"}

    found = sorted(map(tuple, paged.read_paged(spark, ["a", "b"], fetch).collect()), key=str)
    assert found == [("a", "a-1", "t", 5), ("a", "a-2", None, None), ("b", "b-1", "t", 5), ("b", "b-2", None, None)]
    assert paged.read_paged(spark, ["a"], fetch).agg(F.count("*")).first()[0] == 2
