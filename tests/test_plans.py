"""Objects to versions to answers, templates, cost, streams, command line."""

import datetime as dt
import io
import json
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators.log import Log
from palimpsest.operators.upsert import VersionedTable, apply_ddl, only_new
from palimpsest.plans import corpus, pipeline, silver
from palimpsest.plans.ask import Assistant
from palimpsest.plans.service import Service
from palimpsest.plans.templates import TemplateError, Templates
from palimpsest.sources.objects import protocols, scan_proposals, scan_topics
from palimpsest.streaming import observations

WORDS = " ".join(f"word{i}" for i in range(30))


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("objects")
    proposal = {"id": "0xa", "title": "Fee switch", "body": f"Turn fees on. {WORDS}", "state": "active", "start": 10, "end": 20, "created": 5, "scores": [1, 2], "scores_total": 3, "votes": 4, "space": {"id": "aavedao.eth"}, "author": "x"}
    write(top / "snapshot/space=aavedao.eth/0xa/1.json", proposal)
    write(top / "snapshot/space=nobody.eth/0xz/1.json", proposal | {"id": "0xz", "space": {"id": "nobody.eth"}})
    write(top / "snapshot/space=ens.eth/0xb/1.json", {"id": "0xb", "title": "Short", "body": "Yes.", "space": {"id": "ens.eth"}})
    posts = [{"id": 1, "post_number": 1, "cooked": f"<p>Hello {WORDS}</p>", "updated_at": "2024-01-01T00:00:00Z"}, {"id": 2, "post_number": 1, "cooked": "<p>+1</p>"}, {"id": None, "cooked": WORDS}]
    for host in ("gov.uniswap.org", "governance.aave.com", "nobody.org"):
        write(top / f"discourse/space={host}/7/1.json", {"id": 7, "title": "Delegates", "post_stream": {"posts": posts}})
    write(top / "discourse/space=gov.uniswap.org/8/1.json", {"id": 8, "title": "FAQ", "post_stream": {"posts": posts}})
    write(top / "discourse/space=gov.uniswap.org/9/1.json", {"id": 9, "title": "listed without bodies"})
    out = str(top / "out")
    run = lambda: pipeline.run(spark, str(top / "snapshot"), str(top / "discourse"), out)
    return out, run(), run()


def test_first_and_second_run(built):
    _, first, second = built
    assert first["proposal_versions"] == {"inserts": 2, "updates": 0}
    assert first["forum_posts"] == {"inserts": 9, "updates": 0}
    assert first["dropped"] == {"boilerplate": 3, "unaddressable": 2, "short": 2}
    assert first["vectors"]["inserts"] == 3  # equal posts on two hosts share a text and are embedded once
    assert (first["embedding"]["texts"], first["embedding"]["calls"], first["embedding"]["billed"]) == (3, 1, 75)  # the second run calls nobody
    assert second == first | {"embedding": dict.fromkeys(first["embedding"], 0), "proposal_versions": {"inserts": 0, "updates": 0}, "forum_posts": {"inserts": 0, "updates": 0}, "vectors": {"inserts": 0, "updates": 0}, "cost": 0.0}


def test_only_the_protocols_are_broadcast(spark, built):
    """Objects are estimated by their files' names, so Spark would broadcast them whole where nothing says otherwise."""
    top, known = built[0].removesuffix("/out"), protocols(spark)
    made = silver.build(scan_proposals(spark, f"{top}/snapshot"), scan_topics(spark, f"{top}/discourse"), known)
    kept, lost = silver.drop_unknown(made[0], known, "space_id", "snapshot_space")
    joined = lambda df: re.findall(r"(SortMergeJoin|BroadcastHashJoin).*?(BuildLeft|BuildRight|$)", df._jdf.queryExecution().executedPlan().toString(), re.M)
    for df, n in ((made[0], 1), (made[1], 1), (kept, 2), (lost, 2)):
        assert joined(df) == [("BroadcastHashJoin", "BuildRight")] * n
    # In the corpus, too; a proposal's count meets its chunks by a shuffle.
    assert sorted(joined(corpus.load(*made, known)[0])) == [("BroadcastHashJoin", "BuildRight")] * 6 + [("SortMergeJoin", "")]


def test_stored_keys_are_not_broadcast(spark, tmp_path):
    row = lambda n: spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("v"))
    row(3).write.parquet(f"{tmp_path}/stored")
    found = only_new(row(5), spark.read.parquet(f"{tmp_path}/stored"), ["k"])
    assert sorted(r.k for r in found.collect()) == [3, 4]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_same_topic_on_two_hosts_keeps_apart(spark, built):
    posts = VersionedTable(spark, f"{built[0]}/forum_posts").read()
    assert {r.protocol_name for r in posts.where("topic_id = 7").collect()} == {"uniswap", "aave"}
    assert posts.where("is_current").count() == posts.count()


def test_answers(spark, built):
    out = built[0]
    tables = [VersionedTable(spark, f"{out}/{n}").read() for n in ("proposal_versions", "forum_posts")]
    me = Assistant(spark, VersionedTable(spark, f"{out}/vectors").read(), Templates(*tables), protocols(spark))
    counted = me.ask("how many proposals are there")
    assert not counted.data_gap and {r["protocol_name"]: r["n"] for r in counted.rows} == {"aave": 1, "ens": 1}
    cited = me.ask("word1 word2 word3 word4 fees")
    assert cited.citations and cited.citations[0]["marker"] == "c0" and "nothing from arbitrum" in cited.note
    assert me.ask("zzzz qqqqq unheard").data_gap
    # A writer may say itself that the passages don't answer the question; what it cites stays.
    me.writer = lambda question, passages, rows: {"answer": " Not in here [c0]. ", "data_gap": True}
    said = me.ask("word1 word2 word3 word4 fees")
    assert said.data_gap and said.text == "Not in here [c0]." and said.citations
    me.writer = lambda question, passages, rows: {"answer": None}
    assert me.ask("word1 word2 word3 word4 fees").data_gap


def test_service(spark, built):
    out = built[0]
    tables = [VersionedTable(spark, f"{out}/{n}").read() for n in ("proposal_versions", "forum_posts")]
    templates = Templates(*tables)
    served = Service(spark, templates, Assistant(spark, VersionedTable(spark, f"{out}/vectors").read(), templates, protocols(spark)))

    def call(method, path, query="", body=b""):
        said = []
        parts = served({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda status, heads: said.append((int(status[:3]), heads[0][1])))
        raw = b"".join(parts).decode()
        return said[0][0], json.loads(raw) if said[0][1].startswith("application/json") else raw

    assert call("GET", "/health") == (200, {"status": "ok", "engine": {"status": "ok"}})
    status, listed = call("GET", "/api/v1/proposals", "protocol=aave&limit=5")
    assert status == 200 and [p["proposal_id"] for p in listed] == ["0xa"]
    assert call("GET", "/api/v1/proposals", "protocol=nobody")[0] == 400 and call("GET", "/api/v1/proposals", "limit=ten")[0] == 400
    assert call("GET", "/api/v1/proposals/0xa")[1]["title"] == "Fee switch" and call("GET", "/api/v1/proposals/0xq")[0] == 404
    assert len(call("GET", "/api/v1/proposals/0xa/history")[1]) == 1 and call("GET", "/api/v1/proposals/a'b")[0] == 400
    assert call("POST", "/api/v1/proposals")[0] == 405 and call("GET", "/api/v1/chat")[0] == 405 and call("GET", "/nowhere")[0] == 404
    status, said = call("POST", "/api/v1/chat", body=json.dumps({"question": "how many proposals are there"}).encode())
    assert (status, said["route"], said["data_gap"]) == (200, "sql", False) and call("POST", "/api/v1/chat", body=b"{")[0] == 400
    events = call("GET", "/api/v1/chat/stream", "question=word1+word2+word3+word4+fees")[1]
    assert [e.partition("\n")[0] for e in events.strip().split("\n\n")] == ["event: router", "event: vector", "event: synthesis"]
    served.assistant.router = lambda *a: 1 / 0
    assert call("GET", "/api/v1/chat/stream", "question=x")[1].startswith("event: error") and call("GET", "/api/v1/chat/stream")[0] == 400


def test_command_line(spark, built, capsys, monkeypatch):
    assert cli.main(["search", "fee switch word1 word2", "--data", built[0], "--json", "--min-gap", "0", "--max-distance", "2"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    out = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    asked = ["search", "zzzz qqqqq unheard", "--data", built[0], "--json"]
    assert cli.main(asked) == 0 and out() == []
    assert cli.main([*asked, "--no-threshold"]) == 0 and len(out()) == 3
    assert cli.main([*asked, "--no-threshold", "--as-of", "2000-01-01"]) == 0 and out() == []
    assert cli.main([*asked, "--no-threshold", "--model", "other"]) == 0 and out() == []
    assert cli.main(["search", "zzzz", "--data", built[0]]) == 0 and "--no-threshold" in capsys.readouterr().out
    assert cli.snippet("a " * 400, 20, 2).endswith(" ...") and cli.snippet("short") == "short"


def test_templates(spark):
    rows = [("a", "aave", "active", 1, 2.0, True, dt.datetime(2024, 1, n)) for n in range(1, 4)] + [("b", "ens", "closed", None, None, False, None)]
    df = spark.createDataFrame(rows, "proposal_id string, protocol_name string, proposal_state string, vote_count long, scores_total double, is_current boolean, proposal_created timestamp").withColumn("title", F.lit("t"))
    t = Templates(df, df.withColumn("topic_id", F.lit(1)))
    assert t.render("count_proposals", {"protocol": "AAVE", "state": "Active"}).first().n == 3
    assert t.render("list_proposals", {"since": "2024-01-02", "limit": 1, "offset": 1}).first().proposal_created.day == 2
    assert t.render("list_proposals", {"limit": 0, "offset": -5}).count() == 1
    assert t.render("forum_volume").first().topics == 1
    for name, params in [("nope", {}), ("count_proposals", {"protocol": "x"}), ("top_proposals_by", {"field": "title"}), ("top_proposals_by", {}), ("get_proposal", {"proposal_id": "a' or 1=1"}), ("get_proposal", {}), ("list_proposals", {"limit": "ten"}), ("list_proposals", {"limit": True}), ("list_proposals", {"since": "soon"})]:
        with pytest.raises(TemplateError):
            t.render(name, params)
    assert t.catalogue().count("\n") == 7


def test_cost_ceiling(spark):
    df = spark.createDataFrame([(1_000_000,)], "tokens long")
    assert corpus.check_cost(df, 0.2) == 0.131
    with pytest.raises(corpus.CostError):
        corpus.check_cost(df, 0.1)
    assert corpus.check_cost(df.limit(0)) == 0


def test_ddl(spark):
    assert apply_ddl(spark, "create temporary view v as select 1 a; \n; select * from v;") == 2


def test_stream_folds_late_observations(spark, tmp_path):
    schema = "entity string, record_hash string, observed_at timestamp"
    at = [dt.datetime(2026, 8, n) for n in (1, 2, 3)]
    table, log = VersionedTable(spark, str(tmp_path / "t")), Log(spark, str(tmp_path / "l"), ["entity"])

    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        observations.fold_into(stream, table, log, str(tmp_path / "c")).awaitTermination()
        return sorted((r.record_hash, r.valid_from, r.valid_to) for r in table.read().collect())

    assert step([("A", "x", at[0]), ("A", "z", at[2])]) == [("x", at[0], at[2]), ("z", at[2], None)]
    assert step([("A", "y", at[1])]) == [("x", at[0], at[1]), ("y", at[1], at[2]), ("z", at[2], None)]


def test_stream_of_first_seen_records(spark, tmp_path):
    schema = "entity string, record_hash string, observed_at timestamp"
    rows = [("A", "x", dt.datetime(2026, 8, 1)), ("A", "x", dt.datetime(2026, 8, 1, 1)), ("A", "y", dt.datetime(2026, 8, 1, 2))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = []
    stream = observations.first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["entity"], "record_hash", "observed_at")
    observations.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "c"))
    assert sorted(r.record_hash for r in got) == ["x", "y"]


def test_stream_of_closed_versions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "entity string, record_hash string, observed_at timestamp"
    at = [dt.datetime(2026, 8, n) for n in (1, 2, 3, 4)]
    got = []
    for rows in ([("A", "x", at[0]), ("A", "x", at[1]), ("B", "u", at[0])], [("A", "y", at[2]), ("A", "z", at[3])]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = observations.closed_versions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "entity", "record_hash", "observed_at")
        observations.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "c"))
    assert sorted(map(tuple, got)) == [("A", "x", at[0], at[2]), ("A", "y", at[2], at[3])]
