"""Queries over the shell around models: routing, relevance, citations, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import answers
from palimpsest.operators.embedding import embed, hashing_embedder
from palimpsest.queries.registry import query, table
from palimpsest.shared import scratch

RAW = """
SELECT event_id, CASE event_type WHEN 'click' THEN ' SQL ' WHEN 'error' THEN 'hybrid' ELSE event_type END AS route, CASE WHEN event_id % 3 = 0 THEN 'ONE' WHEN event_id % 3 = 1 THEN 'all' END AS scope,
  CASE WHEN event_id % 4 = 0 THEN 'Aave' WHEN event_id % 4 = 1 THEN 'nobody' END AS protocol, CASE WHEN event_id % 2 = 0 THEN 'forum' ELSE 'news' END AS source,
  CASE WHEN event_id % 5 = 0 THEN '2024-01-01' WHEN event_id % 5 = 1 THEN 'last month' END AS since FROM events
"""
ROUTED = f"""
SELECT event_id, route, CASE WHEN protocol IS NOT NULL AND scope = 'all' AND route <> 'sql' THEN 'one' ELSE scope END AS scope, protocol, source, since FROM (
  SELECT event_id, CASE WHEN lower(trim(route)) IN ('sql', 'vector', 'hybrid') THEN lower(trim(route)) ELSE 'vector' END AS route,
    CASE WHEN lower(trim(coalesce(scope, ''))) IN ('one', 'all') THEN lower(trim(scope)) ELSE 'all' END AS scope, CASE WHEN lower(protocol) IN ('aave', 'ens') THEN lower(protocol) END AS protocol,
    CASE WHEN source IN ('proposal', 'forum') THEN source END AS source, CASE WHEN length(since) = 10 AND substr(since, 5, 1) = '-' THEN since END AS since FROM ({RAW}))
"""


def routed(spark: SparkSession, d: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(kind == "click", " SQL ").when(kind == "error", "hybrid").otherwise(kind).alias("route"),
        F.when(i % 3 == 0, "ONE").when(i % 3 == 1, "all").alias("scope"),
        F.when(i % 4 == 0, "Aave").when(i % 4 == 1, "nobody").alias("protocol"),
        F.when(i % 2 == 0, "forum").otherwise("news").alias("source"),
        F.when(i % 5 == 0, "2024-01-01").when(i % 5 == 1, "last month").alias("since"),
        F.lit(None).cast("string").alias("reason"),
    )
    return answers.normalise_routes(raw, ["aave", "ens"])


@query(ROUTED)
def route_normalise(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).drop("reason")


@query(f"""
SELECT expected_route, count(*) AS questions, round(avg(CASE WHEN route = expected_route THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM (SELECT route, CASE WHEN event_id % 2 = 0 THEN 'vector' WHEN event_id % 7 = 0 THEN 'sql' ELSE 'hybrid' END AS expected_route FROM ({ROUTED})) GROUP BY GROUPING SETS ((expected_route), ())
""")
def routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    scored = routed(spark, d).withColumn("expected_route", F.when(i % 2 == 0, "vector").when(i % 7 == 0, "sql").otherwise("hybrid"))
    found = answers.routing_accuracy(scored, "route", "expected_route")
    return found.select("expected_route", "questions", F.round("accuracy", 9).alias("accuracy"))


@query(f"""
SELECT expected_scope, count(*) AS questions, round(avg(CASE WHEN scope = expected_scope THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM (SELECT scope, CASE WHEN event_id % 3 = 0 THEN 'one' WHEN event_id % 3 = 1 THEN 'all' END AS expected_scope FROM ({ROUTED})) WHERE expected_scope IS NOT NULL GROUP BY GROUPING SETS ((expected_scope), ())
""")
def scope_accuracy(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    scored = routed(spark, d).withColumn("expected_scope", F.when(i % 3 == 0, "one").when(i % 3 == 1, "all"))
    found = answers.scope_accuracy(scored, "scope", "expected_scope")
    return found.select("expected_scope", "questions", F.round("accuracy", 9).alias("accuracy"))


@query("""
WITH chunks AS (SELECT 'tell about ' || lower(n_name) || ' word1 word2 word3 of ' || c_custkey AS chunk FROM customer JOIN nation ON c_nationkey = n_nationkey),
asked AS (
  SELECT 'how many proposals are there' AS question, TRUE AS counting UNION ALL SELECT 'what about nothing3 nothing4 nothing5', FALSE
  UNION ALL SELECT 'tell about ' || lower(n_name) || ' word1 word2 word3', FALSE FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'tell about atlantis word4 word5 word6', FALSE)
SELECT question, NOT counting AND held = 0 AS data_gap, CASE WHEN counting THEN (SELECT count(DISTINCT lower(o_orderpriority)) FROM orders) ELSE 0 END AS rows, held > 0 AS cited
FROM (SELECT question, counting, (SELECT count(*) FROM chunks WHERE starts_with(chunk, question)) AS held FROM asked)
""")
def ask(spark: SparkSession, d: str) -> DataFrame:
    """Questions through the whole assistant, over a chunk for each customer: one counts, some are about the nations of a
    region, two have no answer."""
    from palimpsest.plans.ask import MODEL, SCHEME, Assistant
    from palimpsest.queries.relational import PRIORITIES, templates

    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lower("n_name").alias("n"))
    rows = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.col("c_custkey").cast("string")
    chunk = F.concat(F.lit("tell about "), "n", F.lit(" word1 word2 word3 of "), own)
    chunks = rows.select(
        F.lit("proposal").alias("source"), own.alias("document_id"), F.lit(PRIORITIES[0]).alias("protocol_name"), F.lit(0).cast("long").alias("chunk_index"),
        own.alias("chunk_id"), chunk.alias("chunk"), F.lit(MODEL).alias("embedding_model"), F.lit(SCHEME).alias("chunk_scheme"),
    )
    dimension = spark.createDataFrame([(p,) for p in PRIORITIES], "protocol_name string")
    stored = f"{scratch(spark, 'asked')}/chunks"
    embed(chunks, hashing_embedder).write.parquet(stored)
    me = Assistant(spark, spark.read.parquet(stored), templates(spark, d), dimension)
    about = [f"tell about {r.n} word1 word2 word3" for r in nations.where("n_regionkey = 1").collect()]
    asked = ["how many proposals are there", "what about nothing3 nothing4 nothing5", *about, "tell about atlantis word4 word5 word6"]
    said = [(q, me.ask(q)) for q in asked]
    return spark.createDataFrame([(q, a.data_gap, len(a.rows), bool(a.citations)) for q, a in said], "question string, data_gap boolean, rows bigint, cited boolean")


@query("SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality * 2 + toxic) AS score FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE coalesce(l.score, 0) >= 2")
def judge_filter(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.col("quality") * 2 + F.col("toxic")).alias("score"))
    return answers.keep_relevant(table(spark, d, "documents").select("doc_id"), scores, ["doc_id"])


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS resolved, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_resolution(spark: SparkSession, d: str) -> DataFrame:
    joined = answers.resolve_labels(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], ["quality"])
    return joined.select("doc_id", "resolved", F.coalesce("quality", F.lit(-1)).alias("quality"))


ANSWER = "'see [c' || (turn % 4) || '] and [c' || (conv_id % 7) || '] or [c' || (turn % 4) || ']'"


def answered(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda c: F.concat(F.lit("[c"), c.cast("string"), F.lit("]"))
    t, c = F.col("turn") % 4, F.col("conv_id") % 7
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("see "), mark(t), F.lit(" and "), mark(c), F.lit(" or "), mark(t)).alias("answer"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 = conv_id % 7 THEN 'c' || (turn % 4) ELSE 'c' || (turn % 4) || ',c' || (conv_id % 7) END AS markers FROM (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations)")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("conv_id", "turn", F.array_join(answers.markers(F.col("answer")), ",").alias("markers"))


PASSAGES = "SELECT 'c' || i AS marker, 'forum:' || i || '#' || (10 * i) AS chunk_ref, i / 8.0 AS distance FROM range(4) t(i)"


@query(f"""
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, m.marker, chunk_ref, CAST(round(distance, 4) AS DOUBLE) AS distance,
  CASE WHEN chunk_ref IS NULL THEN '[' || m.marker || '] does not match any retrieved passage' END AS problem
FROM (SELECT conv_id, turn, 0 AS place, 'c' || (turn % 4) AS marker FROM conversations UNION ALL SELECT conv_id, turn, 1, 'c' || (conv_id % 7) FROM conversations WHERE turn % 4 <> conv_id % 7) m
LEFT JOIN ({PASSAGES}) p ON m.marker = p.marker
""")
def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    passages = spark.range(4).select(
        F.concat(F.lit("c"), i.cast("string")).alias("marker"), F.lit("forum").alias("source"), i.cast("string").alias("document_id"), (i * 10).alias("chunk_index"), (i / 8.0).alias("distance")
    )
    return answers.resolve_citations(answered(spark, d), passages, by=["conv_id", "turn"])
