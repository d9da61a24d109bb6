"""An approximate index over vectors: buckets by the sides of random hyperplanes, searched with neighbouring buckets.

Vectors that lie close fall on the same side of most planes. Stored by bucket, a search reads the query's own bucket and
those that differ in a few bits, and ranks what it finds exactly. All native; partition pruning does the skipping.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.search import ranked

BITS, FLIPS, SEED = 8, 2, 11


def planes(dims: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The normals of the hyperplanes: bits x dims, the same for the same seed."""
    return np.random.default_rng(seed).normal(size=(bits, dims))


def bucket_of(embedding: Column, normals: np.ndarray) -> Column:
    """The bucket of a vector: a bit for each plane, set if the vector lies on its positive side. Null for null."""
    found = F.lit(0)
    for i, normal in enumerate(normals):
        plane = F.array(*(F.lit(float(x)) for x in normal))
        dot = F.aggregate(F.zip_with(embedding, plane, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        found = found + F.when(dot >= 0, 1 << i).otherwise(0)
    return F.when(embedding.isNotNull(), found)


def indexed(vectors: DataFrame, normals: np.ndarray, embedding: str = "embedding", out: str = "bucket") -> DataFrame:
    """``vectors`` with their bucket; write them partitioned by it."""
    return vectors.withColumn(out, bucket_of(F.col(embedding), normals))


def probed(query: list[float], normals: np.ndarray, flips: int = FLIPS) -> list[int]:
    """The query's bucket and all that differ from it in up to ``flips`` bits; all of them if that is every bit."""
    own = sum(1 << i for i, side in enumerate(normals @ np.array(query, float) >= 0) if side)
    n = len(normals)
    return sorted(own ^ sum(1 << i for i in some) for k in range(min(flips, n) + 1) for some in combinations(range(n), k))


def near_buckets(query: list[float], normals: np.ndarray, n: int) -> list[int]:
    """The ``n`` buckets most likely to hold neighbours: those that cross the planes nearest to the query (by the sum of
    the squared distances to the planes crossed), its own first."""
    margin = normals @ np.array(query, float) / np.sqrt((normals * normals).sum(1))
    every = np.arange(1 << len(normals))
    own = sum(1 << i for i, side in enumerate(margin >= 0) if side)
    crossed = ((every ^ own)[:, None] >> np.arange(len(normals))) & 1
    return [int(b) for b in np.argsort(crossed @ (margin * margin), kind="stable")[:n]]


def nearest(table: DataFrame, query: list[float], k: int, normals: np.ndarray, flips: int = FLIPS, bucket: str = "bucket", tie: str = "vec_id", buckets: int | None = None) -> DataFrame:
    """The ``k`` nearest of the rows in the buckets that are probed, with their exact distance: those that differ in up to
    ``flips`` bits, or as many ``buckets`` as given, by distance to the planes."""
    wanted = probed(query, normals, flips) if buckets is None else near_buckets(query, normals, buckets)
    return ranked(table.where(F.col(bucket).isin(wanted)), query, k, tie=tie)
