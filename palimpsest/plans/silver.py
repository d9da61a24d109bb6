"""Objects to versions: typed projections, hashes, windows, guarded merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import canonical_time, digest
from palimpsest.functions.text import html_to_text
from palimpsest.operators.scd2 import versions
from palimpsest.operators.upsert import VersionedTable
from palimpsest.schemas import FORUM_POSTS, PROPOSAL_VERSIONS
from palimpsest.sources.objects import ensure_columns

PROPOSAL_KEYS, POST_KEYS = ["proposal_id"], ["forum_host", "topic_id", "post_id"]


def with_protocol(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """``df`` with protocol_name from the dimension, 'unknown' where it has none. The dimension is a handful of rows, and
    said to be the side that is broadcast: by its estimate, which goes by files' names, Spark would take ``df`` instead."""
    names = dimension.select(F.col(dimension_key).alias("__k"), F.col("protocol_name"))
    return df.join(F.broadcast(names), F.col(key) == F.col("__k"), "left").drop("__k").withColumn("protocol_name", F.coalesce("protocol_name", F.lit("unknown")))


def drop_unknown(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of configured keys, and the count of the others by key."""
    known = F.broadcast(dimension.select(F.col(dimension_key).alias(key)).distinct())
    return df.join(known, key, "left_semi"), df.join(known, key, "left_anti").groupBy(key).agg(F.count("*").alias("dropped"))


def _number(c: str) -> Column:
    return F.coalesce(F.format_string("%.9e", F.col(c)), F.lit(""))


def proposals(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """Proposal observations: typed columns, content_hash over title and body, record_hash over what makes a version. The
    space is that of the object's path, of its payload where the path has none."""
    df = raw.select(
        F.col("id").alias("proposal_id"),
        F.coalesce(F.nullif("space_key", F.lit("")), "space.id").alias("space_id"),
        F.lit("snapshot").alias("source"),
        "title",
        "body",
        F.col("discussion").alias("discussion_url"),
        F.col("state").alias("proposal_state"),
        F.col("type").alias("proposal_type"),
        "author",
        F.col("ipfs").alias("ipfs_cid"),
        "link",
        "quorum",
        "scores_total",
        F.col("votes").alias("vote_count"),
        "choices",
        "scores",
        F.timestamp_seconds("start").alias("voting_start"),
        F.timestamp_seconds("end").alias("voting_end"),
        F.timestamp_seconds("created").alias("proposal_created"),
        "source_key",
        "observed_at",
    )
    df = with_protocol(df, dimension, "space_id", "snapshot_space").where("protocol_name <> 'unknown'")
    df = df.withColumn("content_hash", digest("title", "body"))
    return df.withColumn("record_hash", digest("content_hash", "proposal_state", _number("scores_total"), F.col("vote_count").cast("string"), "discussion_url"))


def posts(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """Post observations of topics that have bodies; topics listed without give no rows."""
    rows = raw.where("post_stream.posts is not null").select(
        "forum_host", F.col("id").alias("topic_id"), F.col("title").alias("topic_title"), F.col("slug").alias("topic_slug"), "source_key", "observed_at", F.explode("post_stream.posts").alias("p")
    )
    df = rows.select(
        "forum_host", "topic_id", "topic_title", "topic_slug",
        F.col("p.id").alias("post_id"), F.col("p.post_number").alias("post_number"), F.col("p.username").alias("username"),
        F.col("p.cooked").alias("body_html"), html_to_text(F.col("p.cooked")).alias("body_text"),
        F.try_to_timestamp("p.created_at").alias("post_created_at"), F.try_to_timestamp("p.updated_at").alias("post_updated_at"),
        F.col("p.reply_count").alias("reply_count"), "source_key", "observed_at",
    )
    df = with_protocol(df, dimension, "forum_host", "discourse_host").where("protocol_name <> 'unknown'")
    df = df.withColumn("content_hash", digest("body_html"))
    return df.withColumn("record_hash", digest("content_hash", canonical_time(F.col("post_updated_at")), "topic_title"))


def build(raw_proposals: DataFrame, raw_topics: DataFrame, dimension: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both version tables in their fixed column order."""
    p = ensure_columns(versions(proposals(raw_proposals, dimension), PROPOSAL_KEYS), PROPOSAL_VERSIONS).select(*PROPOSAL_VERSIONS.names)
    f = ensure_columns(versions(posts(raw_topics, dimension), POST_KEYS), FORUM_POSTS).select(*FORUM_POSTS.names)
    return p, f


def merge_into(table: VersionedTable, staged: DataFrame, keys: list[str]) -> dict[str, int]:
    """Upsert versions on their keys and record hash; rebuilding from the same objects writes nothing."""
    return table.merge(staged, [*keys, "record_hash"])
