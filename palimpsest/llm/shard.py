"""Uniform sharding with exact sizes: a hypergeometric communication matrix between partitions and shards.

Every partition learns how many of its rows each shard gets, drawn so that any assignment of rows with the wanted shard
sizes is equally likely. Partitions deal their rows in a random local order, rows are exchanged, and each shard puts
what it received in a random order again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut
from palimpsest.shipping import ship


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good`` + ``bad`` are good: inversion around the mode, for any size."""
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    spread = int(16 * (n * (good / total) * (bad / total)) ** 0.5) + 64
    up = np.arange(mode, min(hi, mode + spread), dtype=float)
    down = np.arange(mode, max(lo, mode - spread), -1, dtype=float)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    edges = np.cumsum(weight)
    return mode - len(below) + int(np.searchsorted(edges, rng.random() * edges[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard. Shard sizes differ by one at most; sums by partition are ``rows``."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        rest, left = sum(room), n
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left) if s + 1 < shards else left
            out[p, s] = k
            room[s] -= k
            left -= k
    return out


def deal(docs: DataFrame, shards: int, seed: int = 17, block: int = 200_000) -> DataFrame:
    """``docs`` with shard int and slot long: shard sizes differ by one at most, slots of a shard count from 0.

    Rows are opaque: null, repeated or very long values make no difference, and an empty table gives an empty result.
    A column of ``docs`` named shard, slot or like the internal ones is an error. What ``docs`` holds is written once
    to the shared folder so that the counts and the exchange see the same partitions when executors are lost; select
    only what the shards must carry. The driver holds partitions x shards counts, never rows. Slots are ranks of random
    numbers, counted in blocks of about ``block`` rows, so no task sorts a whole shard.
    """
    if clash := {"shard", "slot", "__p", "__r", "__b"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    spark = docs.sparkSession
    ship(spark)
    held = cut(docs.withColumn("__p", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in held.groupBy("__p").count().collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    total = sum(counts.values())
    blocks = max(1, -(-total // (shards * block)))
    sent = spark.sparkContext.broadcast({p: matrix[i] for i, p in enumerate(parts)})

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rng, at = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if labels is None:
                p = batch.column(batch.num_columns - 1)[0].as_py()
                rng = np.random.default_rng([seed, 1 + p])
                labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), sent.value[p]))
            drawn = rng.integers(0, 1 << 62, n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels[at : at + n]), pa.array(drawn)],
                names=[*batch.schema.names[:-1], "shard", "__r"],
            )
            at += n

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__r", T.LongType())])
    dealt = held.mapInArrow(permute, schema).withColumn("__b", F.shiftright("__r", 40) * F.lit(blocks) / F.lit(1 << 22))
    dealt = dealt.withColumn("__b", F.floor("__b").cast("int"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "__b")
        .agg(F.count("*").alias("n"))
        .select("shard", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    )
    place = Window.partitionBy("shard", "__b").orderBy("__r")
    return (
        dealt.withColumn("__k", F.row_number().over(place))
        .join(starts, ["shard", "__b"])
        .select(*docs.columns, "shard", (F.col("__start") + F.col("__k") - 1).cast("long").alias("slot"))
    )
