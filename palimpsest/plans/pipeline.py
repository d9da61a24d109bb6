"""The whole run: harvest to objects to versions to chunks to vectors, each step skipping what is already there."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.identity import VOLATILE, json_hash, object_key
from palimpsest.operators.embedding import Embedder, embed, hashing_embedder, usage
from palimpsest.operators.upsert import VersionedTable
from palimpsest.plans import corpus, silver
from palimpsest.shared import scratch
from palimpsest.sources.objects import protocols, scan_proposals, scan_topics, write_manifest, write_objects
from palimpsest.sources.paged import OBJECTS, Transport, proposal_objects, read_paged, topic_objects


def harvest(spark: SparkSession, transport: Transport, path: str, run: str, names: list[str] | None = None, proposals: int = 100, topics: int = 30, per_minute: float = 60.0, most: int = 10) -> dict[str, Any]:
    """Fetch every protocol's proposals and topics (all, or those of ``names``) into content-addressed objects under
    ``path``: snapshot/space=.../ and discourse/space=.../, at most ``topics`` of ``most`` pages of a forum. Counts by source; they also go into a manifest of the run."""
    known = protocols(spark, names)
    report: dict[str, Any] = {}
    for source, column, fetch, volatile in (
        ("snapshot", "snapshot_space", proposal_objects(transport, proposals, per_minute), ()),
        ("discourse", "discourse_host", topic_objects(transport, topics, per_minute, most), VOLATILE),
    ):
        spaces = [r[0] for r in known.select(column).collect()]
        found = json_hash(read_paged(spark, spaces, fetch, OBJECTS), "payload", volatile)
        keyed = found.withColumn("key", object_key(F.lit(source), F.col("space_key"), F.col("id"), F.col("hash")))
        report[source] = write_objects(keyed, path)
    write_manifest(spark, path, run, report)
    return report


def run(
    spark: SparkSession, proposals_path: str, topics_path: str, out: str, embedder: Embedder = hashing_embedder,
    model: str = "hashing", scheme: str = "v2", ceiling: float = corpus.CEILING,
) -> dict[str, Any]:
    """Build and merge both version tables, then embed the chunks that are new under a cost ceiling; a report."""
    dimension = protocols(spark)
    p, f = silver.build(scan_proposals(spark, proposals_path), scan_topics(spark, topics_path), dimension)
    tables = {n: VersionedTable(spark, f"{out}/{n}", ["protocol_name"]) for n in ("proposal_versions", "forum_posts")}
    report: dict[str, Any] = {
        "proposal_versions": silver.merge_into(tables["proposal_versions"], p, silver.PROPOSAL_KEYS),
        "forum_posts": silver.merge_into(tables["forum_posts"], f, silver.POST_KEYS),
    }
    current = [tables[n].read() if tables[n].versions() else df for n, df in (("proposal_versions", p), ("forum_posts", f))]
    chunks, dropped = corpus.load(*current, dimension)
    vectors = VersionedTable(spark, f"{out}/vectors", ["embedding_model"])
    stored = vectors.read().where((F.col("embedding_model") == model) & (F.col("chunk_scheme") == scheme)) if vectors.versions() else chunks.limit(0)
    fresh = corpus.pending(chunks, stored)
    report["cost"] = corpus.check_cost(fresh, ceiling)
    paid = scratch(spark, "embedded")
    embed(fresh, embedder, tokens=F.col("tokens"), calls=True).write.parquet(f"{paid}/rows")  # what follows reads it again and pays nothing
    made = spark.read.parquet(f"{paid}/rows")
    report["embedding"] = usage(made).first().asDict()
    made = made.drop("embed_call", "embed_place", "embed_tokens", "embed_billed").withColumns({"embedding_model": F.lit(model), "chunk_scheme": F.lit(scheme)})
    made = made.withColumn("chunk_id", F.sha2(F.concat_ws("|", "content_hash", "chunk_index", "embedding_model", "chunk_scheme"), 256))
    report["vectors"] = vectors.merge(made, ["content_hash", "chunk_index", "embedding_model", "chunk_scheme"])
    report["dropped"] = dropped.first().asDict()
    return report
