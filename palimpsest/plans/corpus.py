"""Current versions to curated chunks, and what embedding them would cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import forum_chunk_index, forum_document
from palimpsest.functions.text import is_boilerplate, is_substantive, label
from palimpsest.operators.chunking import BlankTokenizer, chunk_documents

PRICE, CEILING = 0.131, 5.0


class CostError(RuntimeError):
    """A run that would cost more than allowed."""


def load(proposals: DataFrame, posts: DataFrame, dimension: DataFrame, tokenizer: Callable[[], object] = BlankTokenizer) -> tuple[DataFrame, DataFrame]:
    """(chunks worth embedding, one row of counts of what was dropped and why).

    A proposal's only chunk is kept however short; a post's is not. Posts under boilerplate titles, without an id, or of
    an unknown protocol are dropped; a chunk without a body always is.
    """
    names = F.broadcast(dimension.select("protocol_name", label(F.col("display"), F.col("protocol_name")).alias("label")))
    p = proposals.where("is_current").join(names, "protocol_name")
    made = chunk_documents(p, "label", "title", "body", tokenizer).withColumn("alone", F.lit(None).cast("boolean"))
    counts = made.groupBy("proposal_id").agg((F.count("*") == 1).alias("lone"))
    made = made.join(counts.hint("merge"), "proposal_id").withColumn("keep", is_substantive(F.col("body_tokens"), F.col("lone")))
    common = ["source", "document_id", "protocol_name", "content_hash", "chunk_index", "heading", "chunk", "tokens", "title", "document_date", "valid_from", "valid_to", "keep"]
    a = made.withColumns({"source": F.lit("proposal"), "document_id": F.col("proposal_id"), "document_date": F.col("proposal_created"), "chunk_index": F.col("chunk_index").cast("long")}).select(*common)

    f = posts.where("is_current").join(names, "protocol_name")
    kept = f.where(~is_boilerplate(F.col("topic_title")) & F.col("post_id").isNotNull())
    made = chunk_documents(kept, "label", "topic_title", "body_text", tokenizer).withColumn("keep", is_substantive(F.col("body_tokens")))
    b = made.withColumns(
        {
            "source": F.lit("forum"),
            "document_id": forum_document(F.col("protocol_name"), F.col("topic_id")),
            "document_date": F.col("post_created_at"),
            "title": F.col("topic_title"),
            "chunk_index": forum_chunk_index(F.col("post_id"), F.col("chunk_index")),
        }
    ).select(*common)
    both = a.unionByName(b)
    lost = f.agg(
        F.count_if(is_boilerplate(F.col("topic_title"))).alias("boilerplate"),
        F.count_if(~is_boilerplate(F.col("topic_title")) & F.col("post_id").isNull()).alias("unaddressable"),
    ).crossJoin(both.agg(F.count_if(~F.col("keep")).alias("short")))
    return both.where("keep").drop("keep"), lost


def pending(chunks: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("content_hash", "chunk_index")) -> DataFrame:
    """Chunks not embedded yet, the first of each key: found out before anything is paid for."""
    from palimpsest.operators.upsert import only_new

    return only_new(chunks, stored, list(keys), ["source", "document_id", "chunk_index"])


def estimate(chunks: DataFrame, price: float = PRICE) -> DataFrame:
    total = F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")
    return chunks.agg(F.count("*").alias("chunks"), total.alias("tokens"), F.round(total / 1e6 * price, 6).alias("cost"))


def check_cost(chunks: DataFrame, ceiling: float = CEILING, price: float = PRICE) -> float:
    """The estimated cost; CostError if it is beyond the ceiling."""
    cost = estimate(chunks, price).first().cost
    if cost > ceiling:
        raise CostError(f"{cost:.4f} is more than the ceiling of {ceiling:.4f}")
    return cost


def incomplete(vectors: DataFrame) -> DataFrame:
    """Stored chunks that lack what a citation shows: their title or their document's date."""
    return vectors.where(F.col("title").isNull() | F.col("document_date").isNull())


def completeness(vectors: DataFrame) -> DataFrame:
    """One row: chunks, and how many of them are incomplete."""
    return vectors.agg(F.count("*").alias("chunks"), F.count_if(F.col("title").isNull() | F.col("document_date").isNull()).alias("incomplete"))
