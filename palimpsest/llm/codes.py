"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, all in integers.

A codebook for each part position is refined in rounds over all rows. An entry is found by branch and bound in a
vantage-point tree over the position's entries; executors add up, and only sums for each entry reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import vantage
from palimpsest.llm.common import cut
from palimpsest.shipping import ship

#: Rows that are worked on at once.
BLOCK = 2048
#: Sums travel in digits of this many bits, so that no sum overflows.
DIGIT = 30
#: What fits a long; an error beyond it is given as the greatest one.
MOST = (1 << 63) - 1


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: as longs where sums of squares of their differences fit, else as Python's
    integers. ``scale`` is a power of two."""
    most = float(np.abs(x).max()) * scale if x.size else 0.0
    if 4 * most * most * max(1, x.shape[1]) < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**60 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def doubles(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length, and their vectors as doubles."""
    widths = np.diff(column.offsets.to_numpy())
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        some = column if len(at) == len(widths) else column.take(pa.array(at))
        yield at, some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)


def usable(v: str) -> F.Column:
    """Whether a vector is there and all of it is finite."""
    return F.col(v).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


@dataclass
class Books:
    """The codebooks for vectors of one length: for each part position its entries, as lists of integers."""

    edges: list[int]
    entries: list[list[list[int]]]
    scale: int

    @classmethod
    def seeded(cls, rows: list[list[float]], parts: int, scale: int) -> Books:
        width = len(rows[0])
        edges = [k * width // parts for k in range(parts + 1)]
        whole = floors(np.array(rows, np.float64).reshape(len(rows), width), scale).tolist()
        return cls(edges, [[r[a:b] for r in whole] for a, b in zip(edges, edges[1:], strict=False)], scale)

    def digest(self) -> str:
        """SHA-256 of all entries' integers, by part, entry and place."""
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [c / self.scale for k, part in enumerate(self.entries) for c in part[int(code[2 * k : 2 * k + 2], 16)]]


class Search:
    """Trees over the entries of each part position."""

    def __init__(self, books: Books) -> None:
        self.books, self.arrays, self.trees = books, [], []
        for part in books.entries:
            most = max((abs(c) for e in part for c in e), default=0)
            width = len(part[0])
            kind = np.int64 if 4 * most * most * max(1, books.edges[-1]) < 1 << 62 else object
            held = np.array(part, kind).reshape(len(part), width)

            def far(i: int, some: np.ndarray, held: np.ndarray = held) -> np.ndarray:
                gap = held[some] - held[i]
                return np.sqrt((gap * gap).sum(1).astype(np.float64)) if gap.shape[1] else np.zeros(len(some))

            self.arrays.append(held)
            self.trees.append(vantage.grow(np.arange(len(part)), far, leaf=2))

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part position: its slice of ``x``, the nearest entries, the squared distances."""
        x = floors(x, self.books.scale)
        for k, (a, b) in enumerate(zip(self.books.edges, self.books.edges[1:], strict=False)):
            part, held = x[:, a:b], self.arrays[k]
            if part.dtype != held.dtype:
                part, held = part.astype(object), held.astype(object)
            yield part, *vantage.nearest(self.trees[k], held, part)


def _digits(n: int) -> list[int]:
    """``n`` in digits to the base 2**DIGIT, the last one with the sign."""
    out = []
    while not -(1 << DIGIT) < n < 1 << DIGIT:
        out.append(n & ((1 << DIGIT) - 1))
        n >>= DIGIT
    return [*out, n]


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> dict[int, Books]:
    """Codebooks by length of vector.

    They start as the parts of the ``entries`` smallest ids (ids that are null come last, rows of one id by their
    vectors). Each round assigns all rows and replaces each entry by floor(sum / count) of its own; unused ones stay.
    A round reads ``vectors`` once, and sums of each entry, whose number doesn't depend on the rows, reach the driver.
    Fewer rows than entries make fewer entries; an empty table gives no codebooks.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(usable("v"))
    first = Window.partitionBy(F.size("v")).orderBy(F.col("id").asc_nulls_last(), "v")
    seeds: dict[int, list[list[float]]] = {}
    for r in kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= entries).select("v", "n").orderBy("n").collect():
        seeds.setdefault(len(r.v), []).append(r.v)
    books = {width: Books.seeded(rows, parts, scale) for width, rows in seeds.items()}
    for _ in range(rounds if books else 0):
        sums = _sums(kept, spark.sparkContext.broadcast(books))
        total: dict[tuple[int, int, int, int], int] = {}
        for r in sums.collect():
            key = (r.width, r.part, r.entry, r.place)
            total[key] = total.get(key, 0) + (r.value << (DIGIT * r.digit))
        books = {
            width: Books(one.edges, [
                [[total[width, k, j, c] // total[width, k, j, -1] for c in range(len(e))] if (width, k, j, -1) in total else e for j, e in enumerate(part)]
                for k, part in enumerate(one.entries)
            ], scale) for width, one in books.items()
        }
    return books


def _sums(kept: DataFrame, held) -> DataFrame:  # noqa: ANN001
    """Sums and counts (place -1) of the parts next to each entry, in digits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {w: Search(b) for w, b in held.value.items()}
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                for _, x in doubles(whole.column(0).slice(at, BLOCK)):
                    width = x.shape[1]
                    for k, (part, own, _) in enumerate(search[width].assign(x)):
                        for j in np.unique(own):
                            mine = part[own == j]
                            new = np.array([*mine.sum(0), len(mine)], object)
                            key = (width, k, int(j))
                            total[key] = total[key] + new if key in total else new
        rows = []
        for (width, k, j), sums in total.items():
            for c, n in enumerate(sums):
                rows += [(width, k, j, c if c + 1 < len(sums) else -1, d, v) for d, v in enumerate(_digits(int(n)))]
        if rows:
            kinds = [pa.int32()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["width", "part", "entry", "place", "digit", "value"]
    told = kept.select("v").mapInArrow(add, "width int, part int, entry int, place int, digit int, value long")
    return told.groupBy(*names[:-1]).agg(F.sum("value").alias("value"))


def encode(vectors: DataFrame, books: dict[int, Books], vector: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` whose vector is usable, with code string (two hex digits for each part), error long (squared
    distances to the entries, summed) and codebooks_sha256.

    Vectors that are null, or hold null or non-finite components, are left out, as are lengths without codebooks. Zero
    and repeated vectors are like any others; one without components has entry 0 everywhere and no error. Other columns
    are kept as they are; a column named like one of the new ones is an error.
    """
    if clash := {"code", "error", "codebooks_sha256"} & {c.lower() for c in vectors.columns}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    spark = vectors.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(books)
    kept = vectors.where(usable(vector))
    place = kept.columns.index(vector)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {w: Search(b) for w, b in held.value.items()}
        marks = {w: b.digest() for w, b in held.value.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                some = whole.slice(start, BLOCK)
                for at, x in doubles(some.column(place)):
                    width = x.shape[1]
                    if width not in search:
                        continue
                    own, error = zip(*((o, d) for _, o, d in search[width].assign(x)), strict=True)
                    codes = np.stack(own, 1).astype(np.uint8)
                    wrong = [min(int(e), MOST) for e in sum(e.astype(object) for e in error)] if any(e.dtype == object for e in error) else sum(error)
                    batch = some.take(pa.array(at))
                    new = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(wrong, pa.int64()), pa.array([marks[width]] * len(at), pa.string())]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "code", "error", "codebooks_sha256"])

    fields = kept.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}).schema
    return kept.mapInArrow(write, fields)


#: Groups whose sums are sent to every task; more are joined by a shuffle, which adaptive execution may split.
GROUPS = 100_000


def with_group_errors(coded: DataFrame, group: str = "label") -> DataFrame:
    """``coded`` with label_error long: the errors of all rows of the same group, nulls together.

    ``coded`` is written once to the shared folder, as both the sums and the result read it; leave out what the result
    doesn't need, such as the vectors.
    """
    coded = cut(coded)
    sums = coded.groupBy(F.col(group).alias("__g")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__s"))
    sums = sums.select("__g", F.least("__s", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = coded.select(group).distinct().limit(GROUPS + 1).count() <= GROUPS
    return coded.join(F.broadcast(sums) if few else sums, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
