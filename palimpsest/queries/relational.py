"""Templates, dimensions, counts, top rows and set operations; orders play the proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import variants
from palimpsest.functions.flags import choice_scores, risk_flags
from palimpsest.functions.text import label
from palimpsest.operators import sketches
from palimpsest.operators.scd2 import versions
from palimpsest.plans import reports
from palimpsest.plans.silver import drop_unknown as split_unknown
from palimpsest.plans.templates import Templates
from palimpsest.queries.registry import query, table
from palimpsest.schemas import PROPOSAL_VERSIONS
from palimpsest.sources.objects import ensure_columns

PRIORITIES = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")
PROPOSALS = """
SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, lower(o_orderpriority) AS protocol_name, 'order ' || o_orderkey AS title, lower(o_orderstatus) AS proposal_state,
  o_orderdate AS proposal_created, o_totalprice AS scores_total, o_custkey AS vote_count, o_orderstatus <> 'P' AS is_current, o_orderkey FROM orders
"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("proposal_id"),
        F.lower("o_orderpriority").alias("protocol_name"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lower("o_orderstatus").alias("proposal_state"),
        F.col("o_orderdate").alias("proposal_created"),
        F.col("o_totalprice").alias("scores_total"),
        F.col("o_custkey").alias("vote_count"),
        (F.col("o_orderstatus") != "P").alias("is_current"),
        "o_orderkey",
    )


def templates(spark: SparkSession, d: str) -> Templates:
    posts = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("protocol_name"), F.col("l_orderkey").alias("topic_id"), (F.col("l_linestatus") == "O").alias("is_current"))
    return Templates(proposals(spark, d), posts, PRIORITIES, ("f", "o", "p"))


@query(f"SELECT protocol_name, proposal_state, count(*) AS n FROM ({PROPOSALS}) WHERE is_current AND proposal_state = 'o' GROUP BY ALL")
def count_proposals(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("count_proposals", {"state": "O"})


@query(f"SELECT protocol_name, count(*) AS n FROM ({PROPOSALS}) WHERE is_current GROUP BY ALL")
def count_by_protocol(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("count_by_protocol")


@query(f"SELECT protocol_name, title, vote_count, scores_total, proposal_created FROM ({PROPOSALS}) WHERE is_current ORDER BY scores_total DESC NULLS LAST, proposal_id LIMIT 20")
def top_proposals_by(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("top_proposals_by", {"field": "scores_total", "limit": 20})


@query(f"SELECT protocol_name, title, proposal_created FROM ({PROPOSALS}) WHERE is_current AND proposal_created IS NOT NULL ORDER BY proposal_created, proposal_id LIMIT 5")
def date_extreme(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("proposal_date_extreme", {"direction": "ASC"})


@query("SELECT lower(l_returnflag) AS protocol_name, count(*) AS posts, count(DISTINCT l_orderkey) AS topics FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL")
def forum_volume(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("forum_volume")


@query(f"""
SELECT proposal_id, protocol_name, title, proposal_state, proposal_created, vote_count FROM ({PROPOSALS})
WHERE is_current AND protocol_name = '2-high' AND proposal_created >= TIMESTAMP '1995-01-01' ORDER BY proposal_created DESC NULLS LAST, proposal_id LIMIT 10 OFFSET 20
""")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d).render("list_proposals", {"protocol": "2-HIGH", "since": "1995-01-01", "limit": 10, "offset": 20})


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def get_one(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""
SELECT proposal_id, protocol_name, title, NULL::VARCHAR AS body, proposal_state, NULL::VARCHAR AS author, NULL::TIMESTAMP AS voting_start, NULL::TIMESTAMP AS voting_end, CAST(vote_count AS BIGINT) AS vote_count,
  scores_total, proposal_created, NULL::DOUBLE AS quorum, NULL::VARCHAR[] AS choices, NULL::DOUBLE[] AS scores, NULL::VARCHAR AS discussion_url FROM ({PROPOSALS}) WHERE is_current AND proposal_id = '7'
""")
def get_proposal(spark: SparkSession, d: str) -> DataFrame:
    found = stored(spark, d).render("get_proposal", {"proposal_id": "7"})
    return found.withColumn("proposal_created", F.col("proposal_created").cast("timestamp_ntz"))


def stored(spark: SparkSession, d: str) -> Templates:
    """Orders with every column that versions have."""
    rows = proposals(spark, d).withColumn("valid_from", F.col("proposal_created"))
    return Templates(ensure_columns(rows, PROPOSAL_VERSIONS), None, PRIORITIES, ("f", "o", "p"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS proposal_id, event_type AS title, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(lead(ts) OVER (ORDER BY ts, event_type), '%Y-%m-%d %H:%M:%S.%f') AS valid_to
FROM (SELECT user_id, event_type, min(ts) AS ts FROM events WHERE user_id = 8 GROUP BY ALL)
""")
def get_proposal_history(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("proposal_id"), F.col("event_type").alias("title"), F.col("event_type").alias("record_hash"), F.col("ts").alias("observed_at"))
    made = ensure_columns(versions(log, ["proposal_id"]), PROPOSAL_VERSIONS)
    return Templates(made).render("get_proposal_history", {"proposal_id": "8"}).select("proposal_id", "title", "valid_from", "valid_to")


@query(f"SELECT proposal_id FROM ({PROPOSALS}) WHERE is_current ORDER BY proposal_created DESC NULLS LAST, proposal_id LIMIT 100")
def list_clamped(spark: SparkSession, d: str) -> DataFrame:
    """A limit beyond the most and an offset below zero."""
    return templates(spark, d).render("list_proposals", {"limit": 1000, "offset": -5}).select("proposal_id")


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from FROM events WHERE user_id = 8")
def history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id = 8").orderBy("ts", "event_id")
    return rows.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid_from"))


@query("""
SELECT n_nationkey, n_name, coalesce(r_name, 'unknown') AS protocol_name, coalesce(nullif(CASE WHEN r_name = 'ASIA' THEN '' ELSE r_name END, ''), array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS label
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'EUROPE') ON n_regionkey = r_regionkey
""")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    from palimpsest.plans.silver import with_protocol

    regions = table(spark, d, "region").where("r_name <> 'EUROPE'").withColumnRenamed("r_name", "protocol_name")
    found = with_protocol(table(spark, d, "nation"), regions, "n_regionkey", "r_regionkey")
    shown = F.when(~F.col("protocol_name").isin("ASIA", "unknown"), F.col("protocol_name"))
    return found.select("n_nationkey", "n_name", "protocol_name", label(shown, F.col("n_name")).alias("label"))


@query("SELECT event_type, count(*) AS dropped FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY ALL")
def drop_unknown(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("error",)], "name string")
    return split_unknown(table(spark, d, "events"), known, "event_type", "name")[1]


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def keep_known(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("error",)], "name string")
    return split_unknown(table(spark, d, "events"), known, "event_type", "name")[0].select("event_id", "event_type")


@query(f"SELECT proposal_id, protocol_name, title, proposal_state, proposal_created, scores_total, vote_count, is_current FROM ({PROPOSALS})")
def proposal_projection(spark: SparkSession, d: str) -> DataFrame:
    return proposals(spark, d).drop("o_orderkey")


@query("SELECT conv_id, count(*) AS posts FROM conversations GROUP BY conv_id ORDER BY posts DESC, conv_id LIMIT 10")
def busiest_threads(spark: SparkSession, d: str) -> DataFrame:
    return reports.busiest(table(spark, d, "conversations"), "conv_id")


@query("SELECT 'document' AS source, CAST(doc_id AS VARCHAR) AS document_id, text AS body FROM documents UNION ALL SELECT 'turn', conv_id || ':' || turn, text FROM conversations")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.lit("document").alias("source"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("body"))
    b = table(spark, d, "conversations").select(F.lit("turn").alias("source"), F.concat_ws(":", "conv_id", "turn").alias("document_id"), F.col("text").alias("body"))
    return a.unionByName(b)


@query("SELECT DISTINCT conv_id, role FROM conversations")
def distinct_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "role").distinct()


@query("SELECT lang AS chunk_scheme, count(*) AS n FROM documents GROUP BY ALL")
def count_by_scheme(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_scheme(table(spark, d, "documents"), "lang")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type IN ('error', 'purchase')")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    """The days of each user with clicks but neither errors nor purchases."""
    events = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return reports.missed(events.where("event_type = 'click'"), events.where("event_type in ('error', 'purchase')"), ["user_id", "day"])


@query("""
SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, count(*) AS pages, count(DISTINCT d.lang) AS langs
FROM pages p JOIN documents d ON TRY_CAST(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT) = d.doc_id GROUP BY host
""")
def thread_join(spark: SparkSession, d: str) -> DataFrame:
    joined = reports.linked(table(spark, d, "pages").select("url"), "url", table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return reports.volume(joined, ["host"], "pages", langs="lang")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def explode_turns(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "conversations").groupBy("conv_id").agg(F.struct(F.collect_list(F.struct("turn", "role", "text")).alias("posts")).alias("post_stream"))
    rows = topics.where("post_stream.posts is not null").select("conv_id", F.explode("post_stream.posts").alias("p"))
    return rows.select("conv_id", "p.turn", "p.role", F.length("p.text").cast("long").alias("chars"))


@query("""
SELECT l_orderkey, CAST(i AS INTEGER) AS place, c[i + 1] AS choice, coalesce(s[i + 1], 0.0) AS score FROM (
  SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_quantity) AS c, list(l_quantity ORDER BY l_linenumber, l_returnflag, l_quantity) FILTER (l_linenumber < 4) AS s FROM lineitem GROUP BY l_orderkey), range(len(c)) t(i)
""")
def choice_scores_zip(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    votes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("v"))
    scores = F.transform(F.filter("v", lambda x: x.l_linenumber < 4), lambda x: x.l_quantity)
    made = choice_scores(F.transform("v", lambda x: x.l_returnflag), scores)
    return votes.select("l_orderkey", F.explode(made).alias("c")).select("l_orderkey", "c.place", "c.choice", "c.score")


@query("""
SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 0 AND coalesce(total, 0.0) < o_totalprice THEN 'quorum' END,
  CASE WHEN len(s) >= 2 AND total <> 0 AND (s[1] - s[2]) / total < 0.05 THEN 'close_vote' END, CASE WHEN votes < 10 THEN 'low_turnout' END], lambda x: x IS NOT NULL) AS flags
FROM orders JOIN (SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC) AS s, sum(l_extendedprice) AS total, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY l_orderkey)
ON o_orderkey = l_orderkey
""")
def risk(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list("l_extendedprice").alias("scores"), F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").cast("long").alias("votes")
    )
    joined = table(spark, d, "orders").join(votes, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", risk_flags(F.col("o_totalprice"), F.col("total"), F.col("scores"), F.col("votes")).alias("flags"))


@query("SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS at FROM events")
def unix_ts(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.timestamp_seconds(seconds).alias("at"))


@query("SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS days, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders")
def distinct_dates(spark: SparkSession, d: str) -> DataFrame:
    made = F.col("o_orderdate")
    return table(spark, d, "orders").agg(F.count_distinct(F.to_date(made)).alias("days"), F.min(made).alias("first_at"), F.max(made).alias("last_at"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def scan_json_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.from_json("props", "k bigint").k.alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


DRIFTING = """
SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k":"none","tags":["' || event_type || '","x"]}' WHEN 2 THEN '{"deep":{"v":' || event_id || '.5}}' ELSE '{broken' END AS p FROM events
"""


def drifting(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as if their makers had changed them over time; some are no JSON at all."""
    n = F.col("event_id") % 4
    p = (
        F.when(n == 0, F.col("props"))
        .when(n == 1, F.concat(F.lit('{"k":"none","tags":["'), "event_type", F.lit('","x"]}')))
        .when(n == 2, F.concat(F.lit('{"deep":{"v":'), F.col("event_id").cast("string"), F.lit(".5}}")))
        .otherwise("{broken")
    )
    return table(spark, d, "events").select("event_id", "event_type", variants.parsed(p).alias("v"))


@query(f"""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 < 2 THEN json_extract_string(p, '$.k') END AS k_text,
  CASE WHEN event_id % 4 = 2 THEN CAST(json_extract_string(p, '$.deep.v') AS DOUBLE) END AS deep, CASE WHEN event_id % 4 = 1 THEN json_extract_string(p, '$.tags[0]') END AS tag FROM ({DRIFTING})
""")
def variant_paths(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"k": ("$.k", "bigint"), "k_text": ("$.k", "string"), "deep": ("$.deep.v", "double"), "tag": ("$.tags[0]", "string")}
    return variants.read_paths(drifting(spark, d), "v", wanted).drop("v", "event_type")


@query("""
SELECT event_id % 4 AS maker, count(*) FILTER (event_id % 4 < 3) AS objects,
  CASE event_id % 4 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'OBJECT<k: STRING, tags: ARRAY<STRING>>' WHEN 2 THEN 'OBJECT<deep: OBJECT<v: DECIMAL>>' ELSE 'VOID' END AS schema FROM events GROUP BY ALL
""")
def variant_schemas(spark: SparkSession, d: str) -> DataFrame:
    rows = variants.schemas(drifting(spark, d).withColumn("maker", F.col("event_id") % 4), "v", "maker")
    return rows.withColumn("schema", F.regexp_replace("schema", r"DECIMAL\([0-9,]+\)", "DECIMAL"))


@query("""
SELECT event_type, n AS rows, users, TRUE AS within FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' GROUP BY event_type)
""")
def sketched_users(spark: SparkSession, d: str) -> DataFrame:
    """Users of each kind of event since a day, from the days' sketches, beside the exact count: within 5 percent and 2."""
    events = table(spark, d, "events")
    since = F.lit("2024-01-05").cast("date")
    found = sketches.united(sketches.daily_sketches(events, ["event_type"], "ts", "user_id"), ["event_type"], since)
    exact = events.where(F.to_date("ts") >= since).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return found.join(exact, "event_type").select("event_type", "rows", "users", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users") + 2).alias("within"))
