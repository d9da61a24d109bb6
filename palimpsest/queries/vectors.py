"""Queries over vectors: label plays the document, vec_id % 5 the protocol, even ids the proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import answers, index, search
from palimpsest.operators.pivots import PivotIndex
from palimpsest.queries.registry import query, table
from palimpsest.shared import scratch

#: The query vector is that of vec_id 0.
QUERY_ID = 0
NEAR = f"""
SELECT vec_id, label, CAST(vec_id % 5 AS BIGINT) AS protocol_name, CASE WHEN vec_id % 2 = 0 THEN 'proposal' ELSE 'forum' END AS source, CAST(label AS VARCHAR) AS document_id,
  CASE WHEN vec_id % 3 = 0 THEN 'large' ELSE 'small' END AS embedding_model, CASE WHEN vec_id % 7 = 0 THEN 'v1' ELSE 'v2' END AS chunk_scheme,
  1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})) AS distance FROM embeddings
"""
SHOWN = "round(distance, 6) + 0.0 AS distance"
TOP = f"SELECT * FROM ({NEAR}) ORDER BY distance, vec_id LIMIT {{}}"
CAP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, document_id ORDER BY distance, vec_id) AS n FROM ({})) WHERE n <= {}"
FLAT = """
SELECT round(min(distance), 6) AS best, round(avg(distance) - min(distance), 6) AS gap,
  coalesce(count(*) >= 2 AND min(distance) > 0.42 AND avg(distance) - min(distance) < 0.025, FALSE) AS flat FROM (SELECT * FROM ({}) ORDER BY distance, vec_id LIMIT 10)
"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        (F.col("vec_id") % 5).alias("protocol_name"),
        F.when(F.col("vec_id") % 2 == 0, "proposal").otherwise("forum").alias("source"),
        F.col("label").cast("string").alias("document_id"),
        F.when(F.col("vec_id") % 3 == 0, "large").otherwise("small").alias("embedding_model"),
        F.when(F.col("vec_id") % 7 == 0, "v1").otherwise("v2").alias("chunk_scheme"),
        "embedding",
    )


def shown() -> Column:
    """Distances are full doubles; engines differ in their last bits, so results show six digits."""
    return (F.round("distance", 6) + 0.0).alias("distance")


def query_vector(spark: SparkSession, d: str, vec_id: int = QUERY_ID) -> list[float]:
    """One vector by its id: a point look-up, so one row comes to the driver."""
    found = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return list(found[0]) if found else [0.0]


@query("SELECT round(max(abs(1 - sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 9) AS max_deviation FROM embeddings")
def norm_check(spark: SparkSession, d: str) -> DataFrame:
    return search.norm_deviation(vectors(spark, d)).select(F.round("max_deviation", 9).alias("max_deviation"))


@query(f"SELECT vec_id, {SHOWN}, round(1 - distance, 6) AS similarity FROM ({TOP.format(10)})")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(vectors(spark, d), query_vector(spark, d), 10)
    return hits.select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"), shown())


@query(f"SELECT vec_id, {SHOWN} FROM (SELECT * FROM ({NEAR}) WHERE embedding_model = 'small' AND chunk_scheme = 'v2' AND protocol_name = 2 AND source = 'proposal' ORDER BY distance, vec_id LIMIT 10)")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    seen = search.filtered(vectors(spark, d), model="small", scheme="v2", protocol=2, source="proposal")
    return search.ranked(seen, query_vector(spark, d), 10).select("vec_id", shown())


@query(f"SELECT vec_id, {SHOWN} FROM ({NEAR}) WHERE distance <= 0.7")
def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.within(vectors(spark, d), query_vector(spark, d), 0.7).select("vec_id", shown())


@query(f"SELECT vec_id, source, document_id, {SHOWN} FROM (SELECT * FROM ({CAP.format(TOP.format(40), 1)}) ORDER BY distance, vec_id LIMIT 10)")
def knn_diverse(spark: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(vectors(spark, d), query_vector(spark, d), 40)
    return search.capped(hits, 10, 1).select("vec_id", "source", "document_id", shown())


@query(f"""
SELECT vec_id, protocol_name, {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY protocol_name ORDER BY distance, vec_id) AS place FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protocol_name, source, document_id ORDER BY distance, vec_id) AS of_document FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protocol_name ORDER BY distance, vec_id) AS fetched FROM ({NEAR})) WHERE fetched <= 32)) WHERE of_document = 1)) WHERE place <= 8
""")
def knn_fanout(spark: SparkSession, d: str) -> DataFrame:
    return search.fan_out(vectors(spark, d), query_vector(spark, d), "protocol_name", 8).select("vec_id", "protocol_name", shown())


@query(f"SELECT i AS protocol_name FROM range(8) t(i) WHERE i NOT IN (SELECT protocol_name FROM ({TOP.format(6)}))")
def fanout_empty(spark: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(vectors(spark, d), query_vector(spark, d), 6)
    return search.empty_groups(spark.range(8).withColumnRenamed("id", "protocol_name"), hits, "protocol_name")


@query(FLAT.format(f"SELECT * FROM ({NEAR}) WHERE vec_id <> {QUERY_ID}"))
def flatness_gate(spark: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(vectors(spark, d).where(F.col("vec_id") != QUERY_ID), query_vector(spark, d), 20)
    return search.flatness(hits).select(F.round("best", 6).alias("best"), F.round("gap", 6).alias("gap"), "flat")


FULL = "SELECT * FROM (SELECT * FROM ({cap}) WHERE NOT (SELECT flat FROM ({flat})) ORDER BY distance, vec_id LIMIT 5) WHERE distance <= 0.9"


@query(f"SELECT vec_id, document_id, {SHOWN} FROM ({FULL.format(cap=CAP.format(TOP.format(20), 1), flat=FLAT.format(TOP.format(20)))})")
def search_full(spark: SparkSession, d: str) -> DataFrame:
    return search.search(vectors(spark, d), query_vector(spark, d), 5, max_distance=0.9, model=None, scheme=None).select("vec_id", "document_id", shown())


SMALL = f"SELECT * FROM ({NEAR}) WHERE embedding_model = 'small' AND chunk_scheme = 'v2' ORDER BY distance, vec_id LIMIT 20"


@query(f"SELECT vec_id, document_id, {SHOWN} FROM ({FULL.format(cap=CAP.format(SMALL, 1), flat=FLAT.format(SMALL)).replace('0.9', '2')})")
def search_gated(spark: SparkSession, d: str) -> DataFrame:
    """A search of one model and scheme that lacks the query's own vector, so that the gate sees a flat profile."""
    hits = search.search(vectors(spark, d), query_vector(spark, d), 5, max_distance=2.0, model="small", scheme="v2")
    return hits.select("vec_id", "document_id", shown())


@query(f"""
SELECT vec_id, source FROM ({TOP.format(40)}) WHERE source <> 'proposal' OR document_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')
""")
def hybrid_narrow(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("proposal_id"))
    hits = search.ranked(vectors(spark, d), query_vector(spark, d), 40)
    return search.narrowed(hits, ids).select("vec_id", "source")


MANY = """
SELECT query_id, rank, vec_id, distance, label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, e.label, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance
    FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 5
"""


def many(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.search_many(vectors(spark, d).select("vec_id", "label", "embedding"), queries, 5)


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {SHOWN} FROM ({MANY})")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return many(spark, d).select("query_id", "rank", "vec_id", shown())


RECALL = f"""
SELECT query_id, count(*) AS expected, count(g.label) AS matched, count(g.label) / count(*) AS recall FROM (
  SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0 UNION SELECT vec_id, (label + 1) % 10 FROM embeddings WHERE vec_id % 100 = 0) w
LEFT JOIN (SELECT DISTINCT query_id, label FROM ({MANY})) g USING (query_id, label) GROUP BY query_id
"""


def recalls(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    both = own.unionByName(own.withColumn("label", ((F.col("label") + 1) % 10).cast("int")))
    return answers.recall(both, many(spark, d), "query_id", ["label"])


@query(RECALL)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return recalls(spark, d)


@query(f"SELECT round(sum(matched) / sum(expected), 9) AS micro, round(avg(recall), 9) AS macro FROM ({RECALL})")
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    return answers.recall_summary(recalls(spark, d)).select(F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


EVALUATED = f"""
WITH q AS (SELECT vec_id AS query_id, label, CASE vec_id // 100 % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'lookup' ELSE 'theme' END AS kind FROM embeddings WHERE vec_id % 100 = 0),
hits AS (SELECT query_id, label, distance, vec_id FROM ({MANY})),
expected AS (SELECT query_id, label FROM q UNION SELECT query_id, (label + 1) % 10 FROM q),
found AS (SELECT e.query_id, count(*) AS expected, count(h.label) AS matched FROM expected e LEFT JOIN (SELECT DISTINCT query_id, label FROM hits) h USING (query_id, label) GROUP BY ALL),
gated AS (SELECT query_id, count(*) AS leaked, count(*) FILTER (vec_id % 4 >= 2) AS judge_leaked FROM hits WHERE distance <= 0.62 GROUP BY ALL)
SELECT query_id, kind, coalesce(expected, 0) AS expected, coalesce(matched, 0) AS matched, CASE WHEN kind <> 'negative' THEN matched / expected END AS recall,
  CASE WHEN kind <> 'negative' THEN coalesce(leaked, 0) > 0 END AS answerable, coalesce(leaked, 0) AS leaked, coalesce(judge_leaked, 0) AS judge_leaked,
  CASE WHEN kind = 'negative' THEN coalesce(judge_leaked, 0) = 0 ELSE matched = expected END AS passed
FROM q LEFT JOIN found USING (query_id) LEFT JOIN gated USING (query_id)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    k = F.floor(F.col("query_id") / 100) % 4
    questions = own.select("query_id", F.when(k == 0, "negative").when(k == 1, "lookup").otherwise("theme").alias("kind"))
    expected = own.unionByName(own.withColumn("label", ((F.col("label") + 1) % 10).cast("int")))
    hits = many(spark, d)
    gated = hits.where("distance <= 0.62").withColumn("score", F.col("vec_id") % 4)
    return answers.score_questions(questions, expected, hits, gated, "query_id", ["label"])


@query(EVALUATED)
def score_questions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)


@query(f"""
SELECT round(sum(matched) FILTER (kind <> 'negative') / greatest(1, sum(expected) FILTER (kind <> 'negative')), 9) AS micro, round(avg(recall), 9) AS macro,
  count(*) FILTER (kind <> 'negative') AS positives, count(*) FILTER (answerable) AS survived, count(*) FILTER (kind = 'negative') AS negatives,
  count(*) FILTER (kind = 'negative' AND passed) AS clean, count(*) FILTER (kind = 'negative' AND leaked = 0) AS prefilter_clean FROM ({EVALUATED})
""")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    return answers.evaluation(scored(spark, d)).withColumns({c: F.round(c, 9) for c in ("micro", "macro")})


@query(f"SELECT kind, round(avg(recall), 9) AS recall, count(*) AS questions FROM ({EVALUATED}) WHERE kind <> 'negative' GROUP BY kind")
def recall_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return answers.recall_by_kind(scored(spark, d)).withColumn("recall", F.round("recall", 9))


MARKED = f"SELECT row_number() OVER (ORDER BY distance, vec_id) - 1 AS i, * FROM ({TOP.format(40)})"


@query(f"SELECT vec_id, 'c' || i AS marker FROM ({MARKED}) WHERE i < 24")
def rank_markers(spark: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(vectors(spark, d), query_vector(spark, d), 40)
    return answers.marked(hits).select("vec_id", "marker")


@query(f"SELECT vec_id, route, scope, n FROM (SELECT row_number() OVER (PARTITION BY route, scope ORDER BY distance, vec_id) AS n, * FROM ({TOP.format(40)}), (VALUES ('vector', 'one', 5), ('vector', 'all', 20), ('hybrid', 'one', 20)) s(route, scope, k)) WHERE n <= k")
def k_by_shape(spark: SparkSession, d: str) -> DataFrame:
    hits = lambda route, scope: search.ranked(vectors(spark, d), query_vector(spark, d), answers.wanted(route, scope)).select(
        "vec_id", F.lit(route).alias("route"), F.lit(scope).alias("scope"), F.row_number().over(Window.orderBy("distance", "vec_id")).cast("long").alias("n")
    )
    return hits("vector", "one").unionByName(hits("vector", "all")).unionByName(hits("hybrid", "one"))


@query(f"SELECT vec_id, {SHOWN} FROM ({NEAR}) WHERE distance <= 1e-9")
def ann_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What equals the query lies in its own bucket: an index finds it wherever the planes are."""
    normals = index.planes(len(query_vector(spark, d)))
    stored = scratch(spark, "index")
    index.indexed(vectors(spark, d), normals).write.partitionBy("bucket").mode("overwrite").parquet(stored)
    hits = index.nearest(spark.read.parquet(stored), query_vector(spark, d), 100, normals, flips=0)
    return hits.where("distance <= 1e-9").select("vec_id", shown())


@query(f"SELECT vec_id, {SHOWN} FROM ({TOP.format(10)})")
def ann_all_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Probing every bucket is the exact search."""
    normals = index.planes(len(query_vector(spark, d)), bits=3)
    return index.nearest(index.indexed(vectors(spark, d), normals), query_vector(spark, d), 10, normals, flips=3).select("vec_id", shown())


@query(f"SELECT vec_id, label, {SHOWN} FROM ({TOP.format(10)})")
def pivot_topk(spark: SparkSession, d: str) -> DataFrame:
    """The exact nearest rows through an index, by the bands that their distances to pivots must lie in."""
    made = PivotIndex.build(vectors(spark, d), f"{scratch(spark, 'pivots')}/i")
    return made.nearest(query_vector(spark, d), 10).select("vec_id", "label", shown())


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {SHOWN} FROM ({MANY})")
def pivot_batch(spark: SparkSession, d: str) -> DataFrame:
    """As knn_batch, through the index: queries go to the cells that could hold something nearer."""
    queries = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    made = PivotIndex.build(vectors(spark, d).select("vec_id", "label", "embedding"), f"{scratch(spark, 'pivots')}/i")
    return made.nearest_many(queries, 5).select("query_id", "rank", "vec_id", shown())
