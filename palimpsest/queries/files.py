"""Queries that go through files: objects, dumps, versioned tables, streams, and whole runs over them.

They write to a folder of their own in the shared one. Suppliers play the proposals, conversations the forum's topics.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.functions.identity import VOLATILE, json_hash, object_key
from palimpsest.operators import answers, chunking, embedding
from palimpsest.operators.log import Log
from palimpsest.operators.upsert import VersionedTable, apply_ddl
from palimpsest.plans import corpus, pipeline, silver
from palimpsest.queries.registry import query, table
from palimpsest.queries.versions import VERSIONS
from palimpsest.shared import scratch
from palimpsest.sources import objects, paged
from palimpsest.streaming import observations

SPACES = "['aavedao.eth', 'uniswapgovernance.eth', 'arbitrumfoundation.eth', 'opcollective.eth', 'ens.eth', 'nobody.eth']"
HOSTS = "['governance.aave.com', 'gov.uniswap.org', 'forum.arbitrum.foundation', 'gov.optimism.io', 'discuss.ens.domains', 'nobody.org']"
NAMES = "['aave', 'uniswap', 'arbitrum', 'optimism', 'ens']"


def pick(names: list[str], by: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.col(by) % len(names)).cast("int"))


def put_proposals(spark: SparkSession, d: str, top: str, votes: int = 0) -> dict[str, int]:
    """Suppliers as proposal objects; ``votes`` more than at first make another state of them."""
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("0x"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_name").alias("title"),
            F.concat(F.lit("About "), "s_name").alias("body"),
            F.when(F.col("s_suppkey") % 2 == 0, "active").alias("state"),
            (F.col("s_suppkey") * 60).alias("created"),
            F.col("s_acctbal").alias("scores_total"),
            (F.col("s_nationkey") + votes).alias("votes"),
            F.array(F.lit("yes"), F.lit("no")).alias("choices"),
        )
    )
    rows = table(spark, d, "supplier").select(pick(json.loads(SPACES.replace("'", '"')), "s_suppkey").alias("space"), F.concat(F.lit("0x"), F.col("s_suppkey").cast("string")).alias("id"), payload.alias("payload"))
    keyed = json_hash(rows, "payload").withColumn("key", object_key(F.lit("snapshot"), F.col("space"), F.col("id"), F.col("hash")))
    return objects.write_objects(keyed, top)


def put_topics(spark: SparkSession, d: str, top: str) -> dict[str, int]:
    """Conversations as topic objects: posts are turns, made a minute after each other."""
    post = F.struct(
        F.col("turn").alias("id"),
        F.col("turn").alias("post_number"),
        F.col("role").alias("username"),
        F.concat(F.lit("<p>"), "role", F.lit(" &amp; co</p>")).alias("cooked"),
        F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00.000Z")).alias("created_at"),
        F.length("text").alias("reads"),
    )
    topics = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(post)).alias("posts"))
    host = pick(json.loads(HOSTS.replace("'", '"')), "conv_id")
    payload = F.to_json(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("Topic "), F.col("conv_id").cast("string")).alias("title"), F.struct("posts").alias("post_stream")))
    rows = topics.select(host.alias("host"), F.col("conv_id").cast("string").alias("id"), payload.alias("payload"))
    keyed = json_hash(rows, "payload", VOLATILE).withColumn("key", object_key(F.lit("discourse"), F.col("host"), F.col("id"), F.col("hash")))
    return objects.write_objects(keyed, top)


@query(f"SELECT '0x' || s_suppkey AS id, s_name AS title, s_acctbal AS scores_total, CAST(s_nationkey AS BIGINT) AS votes, ['yes', 'no'] AS choices, NULL::VARCHAR AS author, ({SPACES})[s_suppkey % 6 + 1] AS space_key, TRUE AS seen FROM supplier")
def scan_proposals(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "objects")
    put_proposals(spark, d, top)
    found = objects.scan_proposals(spark, f"{top}/snapshot")
    return found.select("id", "title", "scores_total", "votes", "choices", "author", "space_key", F.col("observed_at").isNotNull().alias("seen"))


@query(f"SELECT conv_id AS id, 'Topic ' || conv_id AS title, ({HOSTS})[conv_id % 6 + 1] AS forum_host, count(*) AS posts, TRUE AS keyed FROM conversations GROUP BY conv_id")
def scan_topics(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "objects")
    put_topics(spark, d, top)
    found = objects.scan_topics(spark, f"{top}/discourse")
    keyed = F.col("source_key").rlike(r"/discourse/space=[^/]+/\d+/[0-9a-f]{32}\.json$")
    return found.select("id", "title", "forum_host", F.size("post_stream.posts").cast("long").alias("posts"), keyed.alias("keyed"))


@query(f"""
SELECT 'Topic ' || conv_id AS topic_title, ({HOSTS})[conv_id % 6 + 1] AS forum_host, conv_id AS topic_id, turn AS post_id, CAST(turn AS INTEGER) AS post_number, ({NAMES})[conv_id % 6 + 1] AS protocol_name, role AS username,
  role || ' & co' || chr(10) AS body_text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn % 60) AS post_created_at, sha256('<p>' || role || ' &amp; co</p>') AS content_hash, TRUE AS is_current FROM conversations WHERE conv_id % 6 < 5
""")
def silver_posts(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "objects")
    put_proposals(spark, d, top)
    put_topics(spark, d, top)
    _, posts = silver.build(objects.scan_proposals(spark, f"{top}/snapshot"), objects.scan_topics(spark, f"{top}/discourse"), objects.protocols(spark))
    return posts.select("topic_title", "forum_host", "topic_id", "post_id", "post_number", "protocol_name", "username", "body_text", "post_created_at", "content_hash", "is_current")


@query(f"""
SELECT '0x' || s_suppkey AS proposal_id, ({NAMES})[s_suppkey % 6 + 1] AS protocol_name, ({SPACES})[s_suppkey % 6 + 1] AS space_id, 'snapshot' AS source,
  sha256(concat_ws(chr(0), sha256(concat_ws(chr(0), s_name, 'About ' || s_name)), CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE '' END, printf('%.9e', s_acctbal), CAST(s_nationkey + v AS VARCHAR), '')) AS record_hash,
  s_name AS title, 'About ' || s_name AS body, CASE WHEN s_suppkey % 2 = 0 THEN 'active' END AS proposal_state, NULL::VARCHAR AS ipfs_cid, s_acctbal AS scores_total, CAST(s_nationkey + v AS BIGINT) AS vote_count,
  to_timestamp(s_suppkey * 60)::TIMESTAMP AS proposal_created
FROM supplier, (VALUES (0), (1)) t(v) WHERE s_suppkey % 6 < 5
""")
def silver_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Two states of each proposal; the columns that time of writing doesn't decide."""
    top = scratch(spark, "objects")
    put_proposals(spark, d, top)
    put_proposals(spark, d, top, votes=1)
    put_topics(spark, d, top)
    made, _ = silver.build(objects.scan_proposals(spark, f"{top}/snapshot"), objects.scan_topics(spark, f"{top}/discourse"), objects.protocols(spark))
    return made.select("proposal_id", "protocol_name", "space_id", "source", "record_hash", "title", "body", "proposal_state", "ipfs_cid", "scores_total", "vote_count", "proposal_created")


@query("SELECT n_name, n_regionkey FROM nation")
def file_sql(spark: SparkSession, d: str) -> DataFrame:
    return objects.query_files(spark, f"{d}/nation.parquet", "n_name, n_regionkey", "parquet")


@query("SELECT event_id, value, NULL::DOUBLE AS absent, event_type AS kind, NULL::INTEGER AS size, NULL::BIGINT AS post_id FROM events")
def tolerant_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", "value", F.struct(F.col("event_type").alias("kind")).alias("s"))
    df = df.select("event_id", objects.optional(df, "value", "double"), objects.optional(df, "absent", "double"), objects.optional_field(df, "s", "kind"), objects.optional_field(df, "s", "size", "int"))
    wanted = schemas.FORUM_POSTS
    whole = objects.ensure_columns(df, wanted).select(*df.columns, "post_id")
    return whole.unionByName(objects.empty(spark, whole.schema))


@query("SELECT * FROM (VALUES ('first', CAST((SELECT count(*) FROM supplier) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)), ('second', 0, (SELECT count(*) FROM supplier), 0)) t(run_id, written, skipped, errors)")
def harvest_counts(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "objects")
    for run in ("first", "second"):
        objects.write_manifest(spark, top, run, put_proposals(spark, d, top))
    return objects.read_manifests(spark, top, "run_id string, written bigint, skipped bigint, errors bigint")


@query("SELECT n_name, ';' AS mark FROM nation WHERE n_regionkey = 1")
def ddl_apply(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("ddl_nation")
    apply_ddl(spark, "-- two; statements\ncreate or replace temporary view ddl_a as select n_name, n_regionkey, ';' as mark from ddl_nation;\ncreate or replace temporary view ddl_b as select n_name, mark from ddl_a where n_regionkey = 1;")
    return spark.table("ddl_b")


@query("SELECT doc_id, lang, n_chars FROM documents")
def partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    stored = VersionedTable(spark, scratch(spark, "table"), ["lang"])
    stored.write(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), ["doc_id"])
    return stored.read().select("doc_id", "lang", "n_chars")


def two_versions(spark: SparkSession, d: str) -> VersionedTable:
    """Orders whose key ends in 0 to 7, then those that end in 2 to 9 with a price of one more where it ends in 5."""
    stored = VersionedTable(spark, scratch(spark, "table"))
    orders, key = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 10
    stored.merge(orders.where(key < 8), ["o_orderkey"])
    staged = orders.where(key > 1).withColumn("o_totalprice", F.col("o_totalprice") + F.when(key == 5, 1).otherwise(0))
    stored.merge(staged, ["o_orderkey"])
    stored.merge(staged, ["o_orderkey"])
    return stored


@query("""
SELECT * FROM (VALUES (1, 'write', NULL, NULL),
  (2, 'merge', (SELECT CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 10 > 7), (SELECT CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 5))) t(number, operation, inserts, updates)
""")
def table_history(spark: SparkSession, d: str) -> DataFrame:
    found = two_versions(spark, d).history()
    return found.select(F.col("version").alias("number"), "operation", objects.map_value(F.col("summary"), "inserts").alias("inserts"), objects.map_value(F.col("summary"), "updates").alias("updates"))


@query("""
SELECT 1 AS version, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 < 8
UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice + 1 ELSE o_totalprice END FROM orders
""")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    stored = two_versions(spark, d)
    return stored.read(1).select(F.lit(1).alias("version"), "*").unionByName(stored.read().select(F.lit(2).alias("version"), "*"))


POSTS = "SELECT *, CASE WHEN conv_id % 6 = 0 THEN 'FAQ' ELSE 'Topic ' || conv_id END AS topic_title, CASE WHEN turn % 4 <> 3 THEN turn END AS post_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda t: t <> '')) AS BIGINT) AS n FROM conversations"


def loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    posts = table(spark, d, "conversations").select(
        F.lit("ens").alias("protocol_name"),
        F.col("conv_id").alias("topic_id"),
        F.when(F.col("conv_id") % 6 == 0, "FAQ").otherwise(F.concat(F.lit("Topic "), F.col("conv_id").cast("string"))).alias("topic_title"),
        F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("post_id"),
        F.col("text").alias("body_text"),
        F.lit(True).alias("is_current"),
    )
    none = objects.empty(spark, schemas.PROPOSAL_VERSIONS)
    return corpus.load(none, objects.ensure_columns(posts, schemas.FORUM_POSTS), objects.protocols(spark))


@query(f"""
SELECT count(*) FILTER (topic_title = 'FAQ') AS boilerplate, count(*) FILTER (topic_title <> 'FAQ' AND post_id IS NULL) AS unaddressable,
  count(*) FILTER (topic_title <> 'FAQ' AND post_id IS NOT NULL AND n < 20) AS short FROM ({POSTS})
""")
def corpus_dropped(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)[1]


@query(f"""
SELECT 'ens:' || conv_id AS document_id, post_id * 100 + i AS chunk_index, topic_title AS title, CAST(CASE WHEN n <= 400 THEN n ELSE least(400, n - i * 320) END + 4 AS INTEGER) AS tokens
FROM ({POSTS}), range(CASE WHEN n <= 400 THEN 1 ELSE CAST(ceil((n - 400) / 320.0) AS BIGINT) + 1 END) t(i) WHERE topic_title <> 'FAQ' AND post_id IS NOT NULL AND n >= 20
""")
def corpus_chunks(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)[0].select("document_id", "chunk_index", "title", "tokens")


@query("SELECT count(*) AS chunks, count(*) FILTER (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END IS NULL OR quality IS NULL) AS incomplete FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return corpus.completeness(joined.select(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), F.col("quality").alias("document_date")))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END IS NULL OR quality IS NULL")
def incomplete(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return corpus.incomplete(joined.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), F.col("quality").alias("document_date"))).select("doc_id")


@query("SELECT count(*) AS rows, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unresolved FROM documents")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    return answers.unresolved(answers.resolve_labels(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], ["quality"]))


def billing_embedder(texts: list[str]) -> dict[str, Any]:
    """An API's whole answer; it bills a token for each word and one for each text."""
    words = sum(len([w for w in t.replace("\n", " ").split(" ") if w]) for t in texts)
    return {"data": counting_embedder(texts), "usage": {"total_tokens": words + len(texts)}}


def counting_embedder(texts: list[str]) -> list[dict[str, Any]]:
    """What an API might answer: items out of order, each with its text's index."""
    return [{"index": i, "embedding": [float(len(texts[i])), float(texts[i].count("e"))]} for i in reversed(range(len(texts)))]


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS es FROM documents")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    made = embedding.embed(table(spark, d, "documents").select("doc_id", "text"), counting_embedder, "text")
    return made.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("es"))


@query("""
SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) + count(*) AS BIGINT) AS billed, CAST(0 AS BIGINT) AS over_texts, CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS early FROM (
  SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda t: t <> '')) AS n FROM documents)
""")
def embed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Whatever the partitions: all texts are embedded once, no call passes a bound, none is closed early."""
    made = embedding.embed(table(spark, d, "documents").select("doc_id", "text"), billing_embedder, "text", calls=True)
    return embedding.usage(made).drop("calls")


@query("SELECT doc_id, CAST(length(text[:900]) % 4 AS INTEGER) AS score FROM documents WHERE length(text[:900]) % 4 >= 2")
def judge_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", F.lit("why?").alias("question"))
    scored = answers.score_passages(rows, lambda questions, texts: [len(t or "") % 4 for t in texts])
    return scored.where(F.col("score") >= answers.RELEVANT).select("doc_id", "score")


@query("SELECT round(CAST(sum(length(text)) AS BIGINT) / 1e6 * 0.131, 6) AS cost, round(CAST(sum(length(text)) AS BIGINT) / 1e6 * 0.131, 6) <= 5 AS allowed FROM documents")
def cost_gate(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.length("text").alias("tokens"))
    try:
        return spark.createDataFrame([(corpus.check_cost(chunks), True)], "cost double, allowed boolean")
    except corpus.CostError:
        return spark.createDataFrame([(corpus.estimate(chunks).first().cost, False)], "cost double, allowed boolean")


class Letters:
    """A tokenizer by characters, to show that any may be passed."""

    def encode(self, text: str) -> list[str]:
        return list(text)

    def decode(self, pieces: list[str]) -> str:
        return "".join(pieces)


@query("""
SELECT conv_id, turn, CAST(i AS INTEGER) AS chunk_index, trim(text[i * 320 + 1 : i * 320 + 400], ' ' || chr(10)) AS chunk FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text FROM conversations),
  range(CASE WHEN length(text) <= 400 THEN CASE WHEN text = '' THEN 0 ELSE 1 END ELSE CAST(ceil((length(text) - 400) / 320.0) AS BIGINT) + 1 END) t(i)
""")
def chunk_any_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_documents(table(spark, d, "conversations").select("conv_id", "turn", "text"), body="text", tokenizer=Letters)
    return made.select("conv_id", "turn", "chunk_index", "chunk")


@dataclass
class TableApi:
    """Both APIs over the given tables, a page at a time: suppliers are the proposals of five spaces, conversations the
    topics of five forums. Each process that asks reads the two tables once."""

    d: str
    upto: int | None = None
    page: int = 30
    known: dict[str, Any] = field(default_factory=dict)

    def __getstate__(self) -> dict[str, Any]:
        return {"d": self.d, "upto": self.upto, "page": self.page, "known": {}}

    def proposals(self, space: str) -> tuple[list[int], list[dict[str, Any]]]:
        """A space's suppliers, newest first, and their negated times."""
        if "proposals" not in self.known:
            found = pq.read_table(f"{self.d}/supplier.parquet", columns=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]).to_pylist()
            by: dict[str, list[dict[str, Any]]] = {}
            for r in sorted(found, key=lambda r: -r["s_suppkey"]):
                if self.upto is None or r["s_suppkey"] <= self.upto:
                    by.setdefault(OWN_SPACES[r["s_suppkey"] % 5], []).append(r)
            self.known["proposals"] = {s: ([-r["s_suppkey"] for r in rows], rows) for s, rows in by.items()}
        return self.known["proposals"].get(space, ([], []))

    def turns(self) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray]:
        """The conversations' columns by conv_id and turn: arrays, as a row would take some hundred bytes as a dictionary."""
        if "turns" not in self.known:
            found = pq.read_table(f"{self.d}/conversations.parquet", columns=["conv_id", "turn", "role"])
            convs, turns = found["conv_id"].to_numpy(), found["turn"].to_numpy()
            order = np.lexsort((turns, convs))
            self.known["turns"] = convs[order], turns[order], found["role"].take(order)
        return self.known["turns"]

    def topics(self, host: str) -> np.ndarray:
        if host not in self.known:
            topics = np.unique(self.turns()[0])
            self.known[host] = topics[topics % 5 == OWN_HOSTS.index(host)] if host in OWN_HOSTS else topics[:0]
        return self.known[host]

    def __call__(self, method: str, url: str, params: dict[str, Any]) -> tuple[int, dict[str, str], Any]:
        if url.endswith("/graphql"):
            v = params["variables"]
            space = v.get("id", v.get("space"))
            times, mine = self.proposals(space)
            if "id" in v:
                return 200, {}, {"data": {"space": {"id": space, "name": space.partition(".")[0], "proposalsCount": len(mine)}}}
            first = 0 if v["createdLt"] is None else bisect_right(times, -v["createdLt"])
            made = [{"id": f"0x{r['s_suppkey']}", "title": r["s_name"], "body": "word " * 30, "state": "active", "created": r["s_suppkey"], "votes": r["s_nationkey"], "scores_total": r["s_acctbal"], "space": {"id": space}} for r in mine[first : first + v["first"]]]
            return 200, {}, {"data": {"proposals": made}}
        host = url.split("/")[2]
        if url.endswith("/latest.json"):
            topics = self.topics(host)[params["page"] * self.page : (params["page"] + 1) * self.page].tolist()
            return 200, {}, {"topic_list": {"topics": [{"id": t} for t in topics]}}
        topic = int(url.rpartition("/")[2].removesuffix(".json"))
        convs, turns, roles = self.turns()
        a, z = np.searchsorted(convs, topic), np.searchsorted(convs, topic, "right")
        posts = [
            {"id": turn, "post_number": turn + 1, "username": role, "cooked": f"<p>{role} {turn % 4} {'word ' * 30}</p>", "created_at": "2024-01-01T00:00:00Z", "reads": 7}
            for turn, role in zip(turns[a:z].tolist(), roles[a:z].to_pylist(), strict=True)
        ]
        return 200, {}, {"id": topic, "title": f"Topic {topic}", "slug": f"topic-{topic}", "post_stream": {"posts": posts}}


OWN_SPACES, OWN_HOSTS = (json.loads(names.replace("'", '"'))[:5] for names in (SPACES, HOSTS))
#: More than any of the tables has: the queries take all there is.
ALL = 1 << 40


def whole(d: str) -> dict[str, Any]:
    return {"transport": TableApi(d), "per_minute": 1e9}


COUNTED = "(SELECT count(*) FROM supplier) AS p, (SELECT count(DISTINCT conv_id) FROM conversations) AS t"


@query(f"""
SELECT source, CASE WHEN r = 'a' THEN n ELSE 0 END AS written, CASE WHEN r = 'a' THEN 0 ELSE n END AS skipped, CAST(0 AS BIGINT) AS errors, r AS run_id
FROM (SELECT unnest(['snapshot', 'discourse']) AS source, unnest([p, t]) AS n FROM (SELECT {COUNTED})), (VALUES ('a'), ('b')) x(r)
""")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Two harvests of the same; the second finds everything there."""
    top = scratch(spark, "harvest")
    rows = []
    for run in ("a", "b"):
        for source, counts in pipeline.harvest(spark, path=top, run=run, proposals=ALL, topics=ALL, most=ALL, **whole(d)).items():
            rows.append((source, counts["written"], counts["skipped"], counts["errors"], run))
    return spark.createDataFrame(rows, "source string, written bigint, skipped bigint, errors bigint, run_id string")


@query("""
SELECT run, name, CAST(CASE WHEN run = 'first' THEN n ELSE 0 END AS INTEGER) AS inserts FROM (
  SELECT unnest(['proposal_versions', 'forum_posts', 'vectors']) AS name, unnest([p, f, p + x]) AS n FROM (
    SELECT (SELECT count(*) FROM supplier) AS p, (SELECT count(*) FROM conversations) AS f, (SELECT count(DISTINCT (role, turn)) FROM conversations) AS x)), (VALUES ('first'), ('second')) r(run)
""")
def pipeline_run(spark: SparkSession, d: str) -> DataFrame:
    """Harvest, build, merge, chunk and embed, twice: equal texts at equal places are embedded once, and the second run adds nothing."""
    top = scratch(spark, "pipeline")
    rows = []
    for run in ("first", "second"):
        pipeline.harvest(spark, path=f"{top}/objects", run=run, proposals=ALL, topics=ALL, most=ALL, **whole(d))
        report = pipeline.run(spark, f"{top}/objects/snapshot", f"{top}/objects/discourse", f"{top}/out")
        rows += [(run, n, report[n]["inserts"]) for n in ("proposal_versions", "forum_posts", "vectors")]
    return spark.createDataFrame(rows, "run string, name string, inserts int")


@query(f"SELECT s AS space, split_part(s, '.', 1) AS name, CAST((SELECT count(*) FROM supplier WHERE s_suppkey % 5 = i) AS INTEGER) AS proposals FROM (SELECT unnest(({SPACES})[1:5]) AS s, unnest(range(5)) AS i)")
def space_lookup(spark: SparkSession, d: str) -> DataFrame:
    client = whole(d)

    def fetch(space: str):
        found = paged.ProposalClient(**client).space(space)
        yield {"space": found["id"], "name": found["name"], "proposals": found["proposalsCount"]}

    spaces = [r[0] for r in objects.protocols(spark).select("snapshot_space").collect()]
    return paged.read_paged(spark, spaces, fetch, "space string, name string, proposals int")


@query(f"SELECT ({HOSTS})[conv_id % 5 + 1] AS forum_host, conv_id AS topic_id, CAST(count(*) AS INTEGER) AS posts FROM conversations GROUP BY conv_id")
def topic_details(spark: SparkSession, d: str) -> DataFrame:
    """All listed topics of each forum, each looked up."""
    client = whole(d)

    def listed(host: str):
        return ({"forum_host": host, "topic_id": t["id"]} for t in paged.ForumClient(host, **client).topics(ALL, ALL))

    hosts = [r[0] for r in objects.protocols(spark).select("discourse_host").collect()]
    topics = paged.read_paged(spark, hosts, listed, "forum_host string, topic_id bigint")
    found = paged.with_details(topics, client["transport"], per_minute=1e9)
    return found.select("forum_host", "topic_id", F.size(F.from_json("payload", schemas.TOPIC).post_stream.posts).alias("posts"))


@query(f"SELECT ({SPACES})[s_suppkey % 5 + 1] AS space_key, '0x' || s_suppkey AS id, s_suppkey AS created, s_name AS title FROM supplier")
def stream_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Proposals followed as a stream that is stopped twice while more of them appear: each arrives once."""
    top = scratch(spark, "stream")
    most = table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] or 0
    for upto in (most // 3, most // 2, most):
        feed = paged.ProposalFeed(TableApi(d, upto), 1e9)
        observations.to_files(paged.stream_paged(spark, OWN_SPACES, feed), f"{top}/out", f"{top}/checkpoint")
    found = spark.read.schema(f"{paged.OBJECTS}, created bigint").parquet(f"{top}/out")
    return found.select("space_key", "id", "created", F.get_json_object("payload", "$.title").alias("title"))



@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sql_rows(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("sql_rows_nation")
    rows = paged.sql_rows(spark, "select n_nationkey, n_name from sql_rows_nation where n_regionkey = :region", region=2)
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus || chr(9) || '\\' || chr(10) END AS status FROM orders")
def copy_block(spark: SparkSession, d: str) -> DataFrame:
    """A dump of orders between blocks of other tables, in files by range, read back by as many tasks as it has splits."""
    top = scratch(spark, "dump")
    orders = table(spark, d, "orders")
    ends = orders.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("z")).first()
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), F.when(F.col("o_orderkey") % 3 == 0, "\\N").otherwise(F.concat("o_orderstatus", F.lit("\\t\\\\\\n"))))
    rows = orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("i"), line.alias("line"))
    other = ["COPY public.region (r, n) FROM stdin;", "1\tother", "\\."]
    around = [((ends.a or 0) - 1, i, x) for i, x in enumerate([*other, "COPY public.orders (o_orderkey, status) FROM stdin;"])] + [((ends.z or 0) + 1, i, x) for i, x in enumerate(["\\.", *other])]
    text = rows.unionByName(spark.createDataFrame(around, rows.schema)).repartitionByRange(8, "k").sortWithinPartitions("k", "i")
    text.select("line").write.text(f"{top}/dump")
    return objects.read_copy(spark, f"{top}/dump", "o_orderkey bigint, status string", "orders")


@query("SELECT '0x' || s_suppkey AS id FROM supplier")
def restore_objects(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "objects")
    put_proposals(spark, d, f"{top}/a")
    objects.restore(spark, f"{top}/a", f"{top}/b")
    return objects.scan_proposals(spark, f"{top}/b").select("id")


LOG = "user_id bigint, event_type string, ts timestamp"


def put_log(spark: SparkSession, d: str, top: str, keep: Column) -> None:
    rows = table(spark, d, "events").where(keep).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.mode("append").parquet(f"{top}/in")


@query(f"SELECT user_id, event_type, valid_from, valid_to, is_current FROM ({VERSIONS})")
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """Versions by a stream that sees the odd events first and the even ones, older among them, after."""
    top = scratch(spark, "stream")
    stored, log = VersionedTable(spark, f"{top}/table"), Log(spark, f"{top}/log", ["user_id"])
    for even in (1, 0):
        put_log(spark, d, top, F.col("event_id") % 2 == even)
        stream = spark.readStream.schema(LOG).parquet(f"{top}/in")
        observations.fold_into(stream, stored, log, f"{top}/checkpoint", "event_type", "ts").awaitTermination()
    # Which of two was current first is no state of the log: the table is what folding all of it gives.
    return stored.read().select("user_id", "event_type", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"), "is_current")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "stream")
    put_log(spark, d, top, F.lit(True))
    seen = observations.first_seen(spark.readStream.schema(LOG).parquet(f"{top}/in"), ["user_id"], "event_type", "ts", "3650 days")
    observations.run_available(seen, lambda df, _: df.write.mode("append").parquet(f"{top}/out"), f"{top}/checkpoint")
    return spark.read.schema(LOG).parquet(f"{top}/out").select("user_id", "event_type")


@query("""
SELECT CAST(user_id AS VARCHAR) AS key, event_type AS record, valid_from, valid_to FROM (
  SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS valid_to FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) WHERE event_type IS DISTINCT FROM before)
WHERE valid_to IS NOT NULL
""")
def stream_closed(spark: SparkSession, d: str) -> DataFrame:
    """A shuffled log in three batches, one after another whatever their size: windows are given, split by what comes late,
    and taken back. A batch asks for the state of all its users, so batches that grew in number with the log, each with
    most users in it, would make the work grow with its square."""
    top = scratch(spark, "stream")
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("turn"))
    rows.write.partitionBy("turn").parquet(f"{top}/in")
    stream = observations.with_rocksdb(spark).readStream.schema(LOG)
    for turn in range(3):
        changes = observations.version_changes(stream.parquet(f"{top}/in/turn={{{','.join(map(str, range(turn + 1)))}}}"), "user_id", "event_type", "ts", "3650 days")
        observations.to_files(changes, f"{top}/out", f"{top}/checkpoint")
    found = observations.closed_of(spark.read.schema(observations.CHANGES).parquet(f"{top}/out"))
    return found.select("key", "record", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))
