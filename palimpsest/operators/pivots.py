"""An exact index over vectors: distances to pivots as sorted columns.

Vectors lie in the cell of their nearest centre, in files sorted by cell, second centre and distance, beside their
distances to a few pivots. For any pivot, |d(row, pivot) - d(query, pivot)| is at most d(row, query): so once some k rows
are known, all that can be nearer lie within a band of each pivot column, and a scan with these bands as filters skips
the files and row groups whose ranges lie outside. What it reads is ranked exactly. For many queries, the ranges of each
cell rule whole cells out.

Distances here are those between unit vectors (chords), which grow with the cosine distance: chord**2 = 2 * cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.search import first_of_each, matrix, meet, ranked, unit
from palimpsest.shared import cut
from palimpsest.shipping import ship

#: Centres of cells, how many of them are pivots, the rows that centres are chosen from, and the rows of a file.
CENTRES, PIVOTS, SAMPLE, ROWS = 64, 16, 4096, 8192
#: Room for rounding: distances are stored as floats.
ROOM = 1e-5


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ centres.T, 0))


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the rows (all different ones, if fewer), each the farthest from those before it."""
    picked, far = [0], _distances(x, x[:1])[:, 0]
    while len(picked) < min(k, len(x)) and far.max() > ROOM:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


@dataclass
class PivotIndex:
    """The index stored at ``path``: ``rows`` with __cell and the pivot columns, and a row for each cell with its centre,
    how many rows it holds, and the range of their distances to each pivot."""

    spark: SparkSession
    path: str
    embedding: str = "embedding"
    tie: str = "vec_id"

    def __post_init__(self) -> None:
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # CENTRES rows at most
        self.centres = np.array([c.centre for c in cells], np.float64)
        self.n = np.array([c.n for c in cells], np.int64)
        self.pivots = len(cells[0].least) if cells else 0
        self.least, self.most = (np.array([getattr(c, f) for c in cells], np.float64) for f in ("least", "most"))
        self.rows = self.spark.read.parquet(f"{self.path}/rows")

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, embedding: str = "embedding", tie: str = "vec_id", centres: int = CENTRES, pivots: int = PIVOTS, rows: int = ROWS
    ) -> PivotIndex:
        """Index all rows of ``vectors`` that have a vector of length over 0: others have no distance to anything.

        Centres come from a sample of at most SAMPLE rows. One pass works out the distances, one sort by ranges lays the
        files out. Vectors must have the same length.
        """
        spark = vectors.sparkSession
        ship(spark)
        there = vectors.where(F.col(embedding).isNotNull() & F.exists(embedding, lambda x: x != 0))
        some = there.orderBy(F.xxhash64(tie), tie).limit(SAMPLE).select(embedding).collect()
        held = spread(unit(np.array([r[0] for r in some], np.float64)), centres) if some else np.zeros((0, 0))
        pivots = min(pivots, len(held))
        at, names = there.columns.index(embedding), [f"__d{i}" for i in range(pivots)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(unit(matrix(batch.column(at))), held)
                order = np.argsort(d, axis=1)[:, :2].astype(np.int32)
                own = d[np.arange(len(d)), order[:, 0]].astype(np.float32)
                columns = [pa.array(order[:, 0]), pa.array(order[:, -1]), pa.array(own), *(pa.array(d[:, i].astype(np.float32)) for i in range(pivots))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "__cell", "__near", "__own", *names])

        schema = ", ".join([*(f"`{n}` {t}" for n, t in there.dtypes), "__cell int, __near int, __own float", *(f"{n} float" for n in names)])
        placed = there.mapInArrow(place, schema).repartitionByRange("__cell", "__near", "__own").sortWithinPartitions("__cell", "__near", "__own")
        placed.drop("__near", "__own").write.option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/rows").groupBy("__cell").agg(
            F.count("*").alias("n"), F.array(*(F.min(c).cast("double") for c in names)).alias("least"), F.array(*(F.max(c).cast("double") for c in names)).alias("most")
        )
        listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held)], "cell int, centre array<double>")
        # An empty cell keeps its place: the numbers of cells are those of their centres.
        whole = listed.join(found, listed["cell"] == found["__cell"], "left").drop("__cell").withColumn("n", F.coalesce("n", F.lit(0)))
        none = F.array_repeat(F.lit(float("inf")), pivots)
        whole.withColumns({"least": F.coalesce("least", none), "most": F.coalesce("most", none)}).coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path, embedding, tie)

    def _homes(self, d: np.ndarray, k: int) -> np.ndarray:
        """Which cells hold at least ``k`` rows, nearest first, for each row of distances to the centres."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, 1)
        return out & (self.n > 0)

    def bands(self, query: list[float], reach: float) -> Column:
        """What every row within a chord of ``reach`` of the query satisfies."""
        found = F.lit(True)
        for i, d in enumerate(_distances(unit(np.array([query], np.float64)), self.centres[: self.pivots])[0]):
            found = found & F.col(f"__d{i}").between(F.lit(float(d - reach - ROOM)), F.lit(float(d + reach + ROOM)))
        return found

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.drop("__cell", *(f"__d{i}" for i in range(self.pivots)))

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The ``k`` nearest rows (of those that satisfy ``where``) with distance, as ``search.ranked`` of all gives.

        The query's own cells say how far the kth can lie; then one scan within the bands of that distance. A query
        without a direction, or with fewer than k rows there that satisfy ``where``, reads everything.
        """
        seen = self.rows if where is None else self.rows.where(where)
        if not len(self.n):
            return ranked(self._shown(seen), query, k, self.embedding, self.tie)
        d = _distances(unit(np.array([query], np.float64)), self.centres)
        home = [int(c) for c in np.flatnonzero(self._homes(d, k)[0])]
        first = ranked(seen.where(F.col("__cell").isin(home)), query, k, self.embedding, self.tie).select("distance").collect()
        if len(first) == k and any(query):
            seen = seen.where(self.bands(query, float(np.sqrt(max(0.0, 2 * max(r[0] for r in first))))))
        return ranked(self._shown(seen), query, k, self.embedding, self.tie)

    def nearest_many(self, queries: DataFrame, k: int, query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """The ``k`` nearest rows of every query, as ``search.search_many`` of all gives. Queries first visit the cells
        around them, then only the others whose ranges they could reach within their kth distance. A cell's rows are
        dealt by hash into parts of about 2 * ROWS."""
        spark = self.spark
        ship(spark)
        share = np.maximum(1, -(-self.n // (2 * ROWS)))
        first_part = np.cumsum(share) - share
        parts = F.lit(0) if not len(self.n) else F.get(F.array(*(F.lit(int(s)) for s in share)), F.col("__cell"))
        base = F.lit(0) if not len(self.n) else F.get(F.array(*(F.lit(int(s)) for s in first_part)), F.col("__cell"))
        held = self._shown(self.rows.withColumn("__part", (base + F.pmod(F.xxhash64(self.tie, self.embedding), parts)).cast("int")))
        me = (self.centres, self.n, self.pivots, self.least, self.most, share, first_part)
        kind = dict(queries.dtypes)[query]
        asked = queries.select(query, query_vector, F.lit(float("inf")).alias("reach"))

        def route(first: bool):
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                centres, n, pivots, least, most, share, first_part = me
                index = PivotIndex.__new__(PivotIndex)
                index.n = n
                for batch in batches:
                    if not batch.num_rows or not len(n):
                        continue
                    d = _distances(unit(matrix(batch.column(1))), centres)
                    go = index._homes(d, k)
                    if not first:
                        bound = np.zeros(d.shape)
                        for i in range(pivots):
                            bound = np.fmax(bound, np.fmax(least[None, :, i] - d[:, i, None], d[:, i, None] - most[None, :, i]))
                        reach = batch.column(2).to_numpy(zero_copy_only=False)
                        go = ~go & (n > 0) & ~(bound > reach[:, None] + 2 * ROOM)
                    who, cell = np.nonzero(go)
                    times = share[cell]
                    q = np.repeat(who, times)
                    within = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    some = batch.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array((np.repeat(first_part[cell], times) + within).astype(np.int32))], names=[query, query_vector, "__part"])

            return work

        schema = f"`{query}` {kind}, `{query_vector}` {dict(queries.dtypes)[query_vector]}, __part int"
        total = int(share.sum()) if len(self.n) else 1
        near = lambda probes: meet(held, probes, k, self.embedding, self.tie, query, query_vector, total)
        home = cut(first_of_each(near(asked.mapInArrow(route(True), schema)), k, query, self.tie).drop("rank"))
        kth = home.groupBy(query).agg(F.count("*").alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k)
        reach = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("d"))), F.lit(float("inf")))
        again = queries.select(query, query_vector).join(kth, query, "left").select(query, query_vector, reach.alias("reach"))
        return first_of_each(home.unionByName(near(again.mapInArrow(route(False), schema))), k, query, self.tie)
