"""Clean a corpus: quality, repeated lines, near-duplicates, benchmark leaks, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. ``run`` writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, linededup, minhash, rules, sentencepiece_codec
from palimpsest.llm.common import scratch, table
from palimpsest.llm.queries import GOOD, piece_model

#: The stages can't be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is GOOD or more; rules are learnt from labels that aren't held out."""
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.score(docs, model, out="__score").where(F.col("__score") >= GOOD).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which nothing is left goes. n_chars follows."""
    found = linededup.dedup_lines(docs)
    found = found.where((F.size("dropped") == 0) | (F.size("dropped") < F.col("n_lines")))
    size = F.when(F.size("dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return found.select(*(size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    dropped = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document: doc_id, lang, source, n_tokens, ids."""
    out = sentencepiece_codec.encode_documents(docs, piece_model(), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table ``documents``."""
    top = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
