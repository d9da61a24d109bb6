"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import cut, scratch, shared_dir

__all__ = ["components", "cut", "released", "scratch", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on Arrow batches, after which its Python worker gives back what it no longer needs: Spark keeps workers
    for later tasks, and their free memory counts as the executor's. ``forget`` drops what the work had remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links``: rows (node, component), component the smallest node reachable.

    Every node that occurs in a link is returned; self links only name a node. Each round takes, for every node, the
    smallest label among its neighbours and then jumps to that label's own label, so chains shrink by halves. Labels
    and links stay distributed; hot hubs only meet partial aggregates and joins that adaptive execution may split.
    An empty ``links`` gives no rows.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        told = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").select("u", "m", F.lit(None).cast(labels.schema["l"].dataType).alias("was"))
        heard = told.unionByName(labels.select("u", F.col("l").alias("m"), F.col("l").alias("was"))).groupBy("u").agg(F.max("was").alias("was"), F.min("m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("far"))
        moved = Observation()
        step = heard.join(jump, "l").select("u", "was", F.least("l", "far").alias("l"))
        step = cut(step.observe(moved, F.count_if(F.col("was") != F.col("l")).alias("n")))
        labels = step.select("u", "l")
        if not moved.get["n"]:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
