"""Greedy batches over an ordered list, found in parallel.

A batch takes rows in order until the next would pass a bound on rows or on weight. Whether a row begins a batch depends
on all before it, but where the batch that a row would begin ends depends only on the rows right after it. So rows get
their number and the weight before them (a sort by ranges, sums by partition), blocks of consecutive rows work out for
each row they could be entered at where the next block would be entered, and pointer doubling over these links follows
the one path that starts at the first row. No task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shared import cut
from palimpsest.shipping import ship

MOST_ROWS, MOST_WEIGHT = 128, 100_000
#: Rows of a block, at least four times ``most_rows``.
BLOCK = 1 << 16


def numbered(df: DataFrame, weight: str, order: list[str]) -> DataFrame:
    """``df``, written once to the shared folder, with __at long, its rows' numbers in order from 0, and __before long,
    the weight of all rows before. A null weight is 0. Rows that are alike in ``order`` are in the order of their hashes;
    a range of the order that is all alike is still split between tasks."""
    hashed = [n for n, t in df.dtypes if not t.startswith(("map", "variant"))]
    keys = [*order, F.xxhash64(*hashed), F.monotonically_increasing_id()]
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select("*", *((F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)))
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    at_weight = df.columns.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            w = batch.column(at_weight).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            sums = np.cumsum(w)
            new = [np.full(n, part, np.int32), rows + np.arange(n), total + sums - w]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*batch.schema.names, "__part", "__at", "__before"])
            rows, total = rows + n, total + (int(sums[-1]) if n else 0)

    local = cut(placed.mapInArrow(run, _with(df, "__part int, __at long, __before long")))
    ends = local.groupBy("__part").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(weight).cast("long"), F.lit(0))).alias("w"))
    starts, rows, total = [], 0, 0
    for part, n, w in sorted(map(tuple, ends.collect())):  # a row for each partition
        starts.append((part, rows, total))
        rows, total = rows + n, total + w
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __rows long, __weight long")
    joined = local.join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, (F.col("__at") + F.col("__rows")).alias("__at"), (F.col("__before") + F.col("__weight")).alias("__before"))


def _next(before: np.ndarray, end: int, own: int, most_rows: int, most_weight: int) -> np.ndarray:
    """For the first ``own`` rows, the row at which the batch after theirs would begin. ``before`` are the weights before
    a block's rows and those after it; ``end`` that after the last."""
    edges = np.append(before, end)
    reach = np.searchsorted(edges, before[:own] + most_weight, side="right") - 1
    here = np.arange(own)
    return np.minimum(np.maximum(reach, here + 1), here + most_rows)


def greedy_batches(df: DataFrame, weight: str, order: list[str], most_rows: int = MOST_ROWS, most_weight: int = MOST_WEIGHT, block: int | None = None) -> DataFrame:
    """``df`` with batch long: rows in order, a new batch when the next would pass either bound.

    Weights are whole and not negative (null: 0); a row heavier than ``most_weight`` is a batch of its own. An empty
    table gives no rows. ``df`` is sorted once and written once; then only its numbers and weights are dealt out, and
    for each block of rows one link for each of the ``most_rows`` + 1 places where it can be entered.
    """
    if clash := {"batch", "__at", "__before", "__part", "__block"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    ship(df.sparkSession)
    size = block or max(BLOCK, 4 * most_rows)
    rows = numbered(df, weight, order)
    own = F.floor(F.col("__at") / size).cast("long")
    also = (F.col("__at") % size < most_rows) & (own > 0)
    blocks = F.explode(F.when(also, F.array(own, own - 1)).otherwise(F.array(own)))
    slim = rows.select("__at", "__before", F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("__w"))

    def of(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        """A block's rows in order, how many are its own, and their next starts."""
        table = table.sort_by("__at").combine_chunks()
        first = table["__block"][0].as_py() * size
        mine = int(np.searchsorted(table["__at"].to_numpy(), first + size))
        before = table["__before"].to_numpy()
        return table, mine, _next(before, int(before[-1]) + table["__w"][-1].as_py(), mine, most_rows, most_weight)

    def link(table: pa.Table) -> pa.Table:
        table, mine, to = of(table)
        count = np.ones(mine, np.int64)
        while (inside := to < mine).any():
            hop = np.where(inside, to, 0)
            count, to = count + np.where(inside, count[hop], 0), np.where(inside, to[hop], to)
        n = min(most_rows, mine)
        at = table["__block"][0].as_py()
        entered = [*zip(range(n), to[:n] - mine, count[:n], strict=True)]
        if n == mine:  # the list ends before a batch begins here
            entered.append((n, 0, 0))
        columns = [[at] * len(entered), [e[0] for e in entered], [at + 1] * len(entered), [e[1] for e in entered], [e[2] for e in entered]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["b", "s", "tb", "ts", "n"])

    jumps = cut(slim.select("*", blocks.alias("__block")).groupBy("__block").applyInArrow(link, "b long, s long, tb long, ts long, n long"))
    reached = df.sparkSession.createDataFrame([(0, 0, 0)], "b long, s long, n long")
    last = (jumps.agg(F.max("b")).first()[0] or 0) + 1
    done = 1
    while done < last:
        hop = reached.alias("r").join(jumps.alias("j"), ["b", "s"]).select(F.col("tb").alias("b"), F.col("ts").alias("s"), (F.col("r.n") + F.col("j.n")).alias("n"))
        reached = cut(reached.unionByName(hop))
        done *= 2
        if done < last:
            far = jumps.select(F.col("b").alias("tb"), F.col("s").alias("ts"), F.col("tb").alias("fb"), F.col("ts").alias("fs"), F.col("n").alias("m"))
            jumps = cut(jumps.join(far, ["tb", "ts"]).select("b", "s", F.col("fb").alias("tb"), F.col("fs").alias("ts"), (F.col("n") + F.col("m")).alias("n")))

    entries = reached.select(F.col("b").alias("__block"), F.col("s").alias("__s"), F.col("n").alias("__n"))
    whole = rows.withColumn("__w", F.coalesce(F.col(weight).cast("long"), F.lit(0))).select("*", blocks.alias("__block")).join(entries, "__block")
    kept = df.columns

    def mark(table: pa.Table) -> pa.Table:
        table, mine, to = of(table)
        begins = np.zeros(mine, np.int64)
        at = table["__s"][0].as_py()
        while at < mine:
            begins[at] = 1
            at = int(to[at])
        batch = table["__n"][0].as_py() + np.cumsum(begins) - 1
        return table.slice(0, mine).select(kept).append_column("batch", pa.array(batch, pa.int64()))

    return whole.groupBy("__block").applyInArrow(mark, _with(df, "batch long"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), more])
