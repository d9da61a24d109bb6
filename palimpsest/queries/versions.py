"""Queries over versions: events are the observation log (user_id the entity, event_type the record, ts the time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.flags import changed_fields
from palimpsest.functions.identity import canonical_time, digest
from palimpsest.operators import scd2, upsert
from palimpsest.queries.registry import query, table
from palimpsest.streaming.observations import daily, sessions

FIRST = """
  SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value
  FROM events GROUP BY user_id, event_type
"""
VERSIONS = f"""
  SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(1) OVER w IS NULL AS is_current, event_id, value
  FROM ({FIRST}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)
"""


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")


def folded(spark: SparkSession, d: str) -> DataFrame:
    return scd2.versions(log(spark, d), ["user_id"], "event_type", "ts")


@query(FIRST)
def scd2_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return scd2.first_observations(log(spark, d), ["user_id"], "event_type", "ts")


@query("SELECT user_id, event_type, max(ts) IS NOT NULL AS seen, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def scd2_keep_last(spark: SparkSession, d: str) -> DataFrame:
    last = scd2.first_observations(log(spark, d), ["user_id"], "event_type", "ts", keep="last")
    return last.select("user_id", "event_type", F.col("ts").isNotNull().alias("seen"), "value")


@query(f"SELECT user_id, event_type, valid_from, valid_to, is_current, event_id FROM ({VERSIONS})")
def scd2_windows(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).select("user_id", "event_type", "valid_from", "valid_to", "is_current", "event_id")


@query(f"SELECT event_type, count(*) AS n FROM ({VERSIONS}) WHERE is_current GROUP BY event_type")
def scd2_current(spark: SparkSession, d: str) -> DataFrame:
    return scd2.current(folded(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""
SELECT user_id, event_type, valid_from FROM ({VERSIONS})
WHERE valid_from <= TIMESTAMP '2024-01-02 00:00:00' AND (valid_to > TIMESTAMP '2024-01-02 00:00:00' OR valid_to IS NULL)
""")
def scd2_as_of(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    return scd2.as_of(folded(spark, d), at).select("user_id", "event_type", "valid_from")


@query(f"""
SELECT e.event_id, v.event_type AS state, v.valid_from AS since
FROM events e ASOF LEFT JOIN ({VERSIONS}) v ON e.user_id = v.user_id AND e.ts >= v.valid_from
""")
def scd2_asof_join(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select("event_id", "user_id", "ts")
    states = folded(spark, d).select("user_id", "valid_from", F.col("event_type").alias("state"), F.col("valid_from").alias("since"))
    return scd2.as_of_join(facts, states, ["user_id"], "ts", ["state", "since"]).select("event_id", "state", "since")


@query(f"SELECT count(*) AS versions, count(DISTINCT user_id) AS entities, count(*) FILTER (is_current) AS current_rows FROM ({VERSIONS})")
def scd2_summary(spark: SparkSession, d: str) -> DataFrame:
    return scd2.summary(folded(spark, d), ["user_id"])


@query(f"SELECT user_id, count(*) FILTER (is_current) AS current_rows FROM ({VERSIONS}) GROUP BY user_id HAVING count(*) FILTER (is_current) <> 1")
def inv_one_current(spark: SparkSession, d: str) -> DataFrame:
    return scd2.not_one_current(folded(spark, d), ["user_id"])


@query(f"""
SELECT user_id, valid_from, valid_to, next_from FROM (
  SELECT user_id, valid_from, valid_to, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, event_type) AS next_from FROM ({VERSIONS}))
WHERE valid_to IS DISTINCT FROM next_from
""")
def inv_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return scd2.gaps(folded(spark, d), ["user_id"], "event_type").select("user_id", "valid_from", "valid_to", "next_from")


@query(f"SELECT user_id, count(*) AS versions FROM ({VERSIONS}) GROUP BY user_id HAVING count(*) > 1")
def multi_version(spark: SparkSession, d: str) -> DataFrame:
    return scd2.multi_version(folded(spark, d), ["user_id"])


@query("""
SELECT user_id, count(DISTINCT event_id) AS record_versions, count(DISTINCT event_type) AS text_versions FROM events
GROUP BY user_id HAVING count(DISTINCT event_id) > count(DISTINCT event_type)
""")
def record_vs_text(spark: SparkSession, d: str) -> DataFrame:
    return scd2.record_and_text(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("""
SELECT event_id, list_filter(['event_type', 'value'], lambda f: CASE f WHEN 'event_type' THEN event_type IS DISTINCT FROM was_type ELSE value IS DISTINCT FROM was_value END) AS changed
FROM (SELECT *, lag(event_type) OVER w AS was_type, lag(value) OVER w AS was_value, lag(1) OVER w AS had FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE had IS NOT NULL
""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lagged = table(spark, d, "events").withColumns({"was_type": F.lag("event_type").over(w), "was_value": F.lag("value").over(w), "had": F.lag(F.lit(1)).over(w)})
    changed = changed_fields(event_type=(F.col("event_type"), F.col("was_type")), value=(F.col("value"), F.col("was_value")))
    return lagged.where("had is not null").select("event_id", changed.alias("changed"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), coalesce(source, ''), coalesce(text, ''))) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", digest("source", "text").alias("content_hash"))


RECORD_HASH = "sha256(concat_ws(chr(0), coalesce(event_type, ''), coalesce(CAST(epoch_us(ts) AS VARCHAR), ''), coalesce(props, '')))"


@query(f"SELECT event_id, {RECORD_HASH} AS record_hash FROM events")
def record_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", digest("event_type", canonical_time(F.col("ts").cast("timestamp")), "props").alias("record_hash"))


@query("""
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS sum_a, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS sum_b
FROM (SELECT sha256(coalesce(text, '')) AS h FROM documents)
""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return scd2.fingerprint(table(spark, d, "documents").select(digest("text").alias("h")), "h")


@query("""
WITH c AS (SELECT h, count(*) AS n FROM (SELECT sha256(coalesce(text, '')) AS h FROM documents) GROUP BY h),
six AS (SELECT substr(h, 1, 6) AS r, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS d FROM c GROUP BY ALL),
four AS (SELECT substr(r, 1, 4) AS r, sha256(string_agg(r || ':' || d, ',' ORDER BY r)) AS d FROM six GROUP BY ALL),
two AS (SELECT substr(r, 1, 2) AS r, sha256(string_agg(r || ':' || d, ',' ORDER BY r)) AS d FROM four GROUP BY ALL)
SELECT sha256(coalesce(string_agg(r || ':' || d, ',' ORDER BY r), '')) AS fingerprint FROM two
""")
def exact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return scd2.exact_fingerprint(table(spark, d, "documents").select(digest("text").alias("h")), "h")


TARGET = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 < 8"
STAGED = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 > 1"
ACTIONS = f"""
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
  CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'keep'
    WHEN t.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR t.o_totalprice IS DISTINCT FROM s.o_totalprice THEN 'update' ELSE 'keep' END AS action
FROM ({TARGET}) t FULL OUTER JOIN ({STAGED}) s ON t.o_orderkey = s.o_orderkey
"""


def merge_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.where(key % 10 < 8).withColumn("o_totalprice", price), orders.where(key % 10 > 1)


@query(f"SELECT count(*) FILTER (action = 'insert') AS inserts, count(*) FILTER (action = 'update') AS updates FROM ({ACTIONS})")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return upsert.action_counts(*merge_sides(spark, d), ["o_orderkey"])


@query(ACTIONS)
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    return upsert.actions(*merge_sides(spark, d), ["o_orderkey"])


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM ({ACTIONS})")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return upsert.upsert(*merge_sides(spark, d), ["o_orderkey"])


@query("""
SELECT doc_id, h AS content_hash FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents)
WHERE n = 1 AND h NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE source = 'src0')
""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", "source", digest("text").alias("content_hash"))
    known = hashed.where("source = 'src0'")
    return upsert.only_new(hashed.select("doc_id", "content_hash"), known, ["content_hash"], ["doc_id"]).select("doc_id", "content_hash")


@query("""
SELECT source, count(DISTINCT h) AS new_objects FROM (SELECT source, sha256(coalesce(text, '')) AS h FROM documents)
WHERE h NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'fr') GROUP BY source
""")
def content_addr_new(spark: SparkSession, d: str) -> DataFrame:
    from palimpsest.sources.objects import put_if_absent

    hashed = table(spark, d, "documents").select("source", "lang", digest("text").alias("h")).withColumn("key", F.concat_ws("/", "source", "h"))
    known = hashed.where("lang = 'fr'").select("h").distinct()
    fresh = put_if_absent(hashed.join(known, "h", "left_anti"), hashed.where("false"))
    return fresh.groupBy("source").agg(F.count("*").alias("new_objects"))


@query("""
SELECT doc_id, coalesce(f.source, d.source) AS source FROM documents d LEFT JOIN (
  SELECT h, source FROM (SELECT sha256(coalesce(text, '')) AS h, source, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1) f
ON sha256(coalesce(d.text, '')) = f.h
""")
def backfill_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", digest("text").alias("h"))
    return upsert.fill_first(docs, docs, "h", ["source"], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_orphans(spark: SparkSession, d: str) -> DataFrame:
    return upsert.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("quality = 0")
    return upsert.without(table(spark, d, "documents").select("doc_id", "source"), gone, ["doc_id"])


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily(table(spark, d, "events"), "ts", ["event_type"])


@query("""
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, s
""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "ts", ["user_id"])
