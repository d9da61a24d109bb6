"""Exact nearest-neighbour search with filters, a flatness gate, a cap by document and a distance ceiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.functions.vectors import cosine_distance
from palimpsest.operators.scd2 import valid_at
from palimpsest.shipping import ship

K, MAX_DISTANCE, MIN_GAP, EXEMPT, PER_DOCUMENT = 5, 0.48, 0.025, 0.42, 1
#: Rows fetched for each one wanted when documents are capped, and the window of the gate.
FETCH, GATE_WINDOW = 4, 10
#: Queries that a task holds at once, and about how many rows each part of the vectors has where more queries meet them.
BLOCK, PART = 4096, 16_384
#: Distances of one matrix product; a product of more goes in slices of queries.
CELLS = 1 << 20


def filtered(
    vectors: DataFrame, *, model: str | None, scheme: str | None, protocol: str | None = None, source: str | None = None, as_of: Column | None = None, **equal: object
) -> DataFrame:
    """Rows a search may see: those of one embedding model and one chunk scheme, as distances between others mean
    nothing; further columns by equality, protocol, source, and what was valid at a time. ``model`` and ``scheme`` must be
    given: None says that the table holds only one."""
    for name, value in {"embedding_model": model, "chunk_scheme": scheme, "protocol_name": protocol, "source": source, **equal}.items():
        if value is not None:
            vectors = vectors.where(F.col(name) == F.lit(value))
    return vectors if as_of is None else vectors.where(valid_at(as_of))


def ranked(vectors: DataFrame, query: list[float], k: int, embedding: str = "embedding", tie: str = "vec_id", unit: bool = False) -> DataFrame:
    """The ``k`` nearest rows with distance; ties by ``tie``.

    The query is a literal, so the plan is a scan, a projection and TakeOrderedAndProject: no join and no shuffle.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("distance", cosine_distance(F.col(embedding), q, unit)).orderBy("distance", tie).limit(k)


def within(vectors: DataFrame, query: list[float], most: float, embedding: str = "embedding", unit: bool = False) -> DataFrame:
    """All rows no further than ``most``, with distance and in no order: a scan and a filter."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("distance", cosine_distance(F.col(embedding), q, unit)).where(F.col("distance") <= most)


def capped(hits: DataFrame, k: int, per_document: int = PER_DOCUMENT, document: list[str] | None = None, tie: str = "vec_id", by: list[str] | None = None) -> DataFrame:
    """At most ``per_document`` rows of a document in order of distance, then ``k`` rows; ``by`` splits into queries."""
    by = by or []
    inside = Window.partitionBy(*by, *(document or ["source", "document_id"])).orderBy("distance", tie)
    hits = hits.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= per_document).drop("__n")
    if not by:
        return hits.orderBy("distance", tie).limit(k)
    overall = Window.partitionBy(*by).orderBy("distance", tie)
    return hits.withColumn("__n", F.row_number().over(overall)).where(F.col("__n") <= k).drop("__n")


def _flat(n: Column, best: Column, mean: Column, min_gap: float, exempt: float) -> Column:
    return F.coalesce((n >= 2) & (best > exempt) & (mean - best < min_gap), F.lit(False))


def flatness(hits: DataFrame, tie: str = "vec_id", by: list[str] | None = None, min_gap: float = MIN_GAP, exempt: float = EXEMPT, window: int = GATE_WINDOW) -> DataFrame:
    """Whether a profile of distances is too flat to hold an answer: by.., best, gap, flat.

    Of the first ``window`` rows: fewer than two, or a best of ``exempt`` or less, never is; else the mean must lie
    ``min_gap`` beyond the best.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy("distance", tie) if by else Window.orderBy("distance", tie)
    head = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= window)
    found = (head.groupBy(*by) if by else head.groupBy()).agg(F.count("*").alias("n"), F.min("distance").alias("best"), F.avg("distance").alias("mean"))
    return found.select(*by, "best", (F.col("mean") - F.col("best")).alias("gap"), _flat(F.col("n"), F.col("best"), F.col("mean"), min_gap, exempt).alias("flat"))


def gated(hits: DataFrame, tie: str = "vec_id", min_gap: float = MIN_GAP, exempt: float = EXEMPT, window: int = GATE_WINDOW) -> DataFrame:
    """``hits``, or nothing if their profile is flat. They are a search's few rows, so one window sees them all."""
    head = F.row_number().over(Window.orderBy("distance", tie)) <= window
    every = Window.partitionBy(F.lit(0))
    kept = hits.withColumn("__d", F.when(head, F.col("distance")))
    flat = _flat(F.count("__d").over(every), F.min("__d").over(every), F.avg("__d").over(every), min_gap, exempt)
    return kept.withColumn("__flat", flat).where(~F.col("__flat")).drop("__d", "__flat")


def search(
    vectors: DataFrame, query: list[float], k: int = K, max_distance: float | None = MAX_DISTANCE, min_gap: float | None = MIN_GAP,
    per_document: int | None = PER_DOCUMENT, document: list[str] | None = None, embedding: str = "embedding", tie: str = "vec_id", **filters: object,
) -> DataFrame:
    """Filters, the nearest rows, the gate on the raw profile, the cap, the ceiling: in this order. Lazy, and one scan."""
    hits = ranked(filtered(vectors, **filters), query, k * FETCH if per_document else k, embedding, tie)
    if min_gap is not None:
        hits = gated(hits, tie, min_gap)
    if per_document:
        hits = capped(hits, k, per_document, document, tie)
    return hits if max_distance is None else hits.where(F.col("distance") <= max_distance)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay."""
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length, without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(q: np.ndarray, x: np.ndarray, ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of ``x`` nearest to each row of ``q``: (query, row, distance), a query's together and in order, ties
    by ``ties``. All are unit vectors. Only rows as near as the kth are sorted. Of the distances, some CELLS are held."""
    if not k or not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    step = max(1, CELLS // len(x))
    parts = [(at, *_best_of(q[at : at + step], x, ties, k)) for at in range(0, len(q), step)]
    return tuple(np.concatenate(c) for c in zip(*((i + at, j, d) for at, i, j, d in parts), strict=True))


def _best_of(q: np.ndarray, x: np.ndarray, ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = 1 - q @ x.T
    near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.ones(d.shape, bool)
    i, j = np.nonzero(near)
    order = np.lexsort((ties[j], d[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], d[i[keep], j[keep]]


def meet(rows: DataFrame, probes: DataFrame, k: int, embedding: str, tie: str, query: str, query_vector: str, tasks: int) -> DataFrame:
    """The ``k`` nearest rows of each probe in each part: query, distance, and the rows' columns but the vector.

    Both sides have __part, ``rows`` so that a part fits into a task. A part's rows are held and its probes stream past
    them, BLOCK at a time, so however many probes come, a task holds no more.
    """
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c not in (embedding, "__part")]
    kinds = dict(rows.dtypes)
    at_query = dict(probes.dtypes)[query]
    none = lambda t: F.lit(None).cast(t)
    left = rows.where(F.col(embedding).isNotNull()).select("__part", F.lit(0).alias("__role"), none(at_query).alias("__q"), F.col(embedding).cast("array<double>").alias("__v"), *kept)
    right = probes.select("__part", F.lit(1).alias("__role"), F.col(query).alias("__q"), F.col(query_vector).cast("array<double>").alias("__v"), *(none(kinds[c]).alias(c) for c in kept))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, held = None, [], None
        for whole in batches:
            parts, roles = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            turns = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (roles[1:] != roles[:-1])]))
            for a, b in zip(turns, [*turns[1:], whole.num_rows], strict=True):
                if roles[a] == 0:
                    if now != parts[a]:
                        now, gathered, held = parts[a], [], None
                    gathered.append(whole.slice(a, b - a))
                    continue
                if now != parts[a]:
                    continue  # a part without rows
                if held is None:
                    t = pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]
                    held, gathered = (t, unit(matrix(t.column(3))), t.column(4 + kept.index(tie)).to_numpy(zero_copy_only=False)), []
                for start in range(a, b, BLOCK):
                    some = whole.slice(start, min(BLOCK, b - start))
                    i, j, d = best_of(unit(matrix(some.column(3))), held[1], held[2], k)
                    yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(i)), pa.array(d), *(held[0].column(4 + n).take(pa.array(j)) for n in range(len(kept)))], names=[query, "distance", *kept])

    schema = ", ".join([f"`{query}` {at_query}", "distance double", *(f"`{c}` {kinds[c]}" for c in kept)])
    both = left.unionByName(right).repartition(max(1, min(tasks, 20_000)), "__part").sortWithinPartitions("__part", "__role")
    return both.mapInArrow(work, schema)


def first_of_each(near: DataFrame, k: int, query: str, tie: str) -> DataFrame:
    """The first ``k`` rows of each query with rank."""
    w = Window.partitionBy(query).orderBy("distance", tie)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, "rank", "distance", *(c for c in near.columns if c not in (query, "distance")))


def search_many(vectors: DataFrame, queries: DataFrame, k: int, embedding: str = "embedding", tie: str = "vec_id", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The ``k`` nearest rows of every query: query, rank, distance, and the rows' columns but the vector.

    Up to BLOCK queries are a block on the driver; each Arrow batch is one matrix product and keeps its k best of every
    query, so what is shuffled is k rows a query and batch. With more queries the vectors are dealt once, by hash, into
    parts of about PART, and queries stream past every part. (``pivots`` has an index that rules parts out.)
    """
    ship(vectors.sparkSession)
    rows = queries.select(query, query_vector).limit(BLOCK + 1).collect()
    kept = [c for c in vectors.columns if c != embedding]
    if len(rows) > BLOCK:
        parts = -(-vectors.count() // PART) or 1
        left = vectors.withColumn("__part", F.pmod(F.xxhash64(tie, embedding), F.lit(parts)).cast("int"))
        right = queries.select(query, query_vector, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
        return first_of_each(meet(left, right, k, embedding, tie, query, query_vector, parts), k, query, tie)
    ids, kind, id_type = [r[0] for r in rows], dict(queries.dtypes)[query], to_arrow_type(queries.schema[query].dataType)
    q = unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1))
    at, at_tie = vectors.columns.index(embedding), vectors.columns.index(tie)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = None
        for whole in batches:
            batch = whole.filter(whole.column(at).is_valid())
            if not batch.num_rows or not ids:
                continue
            named = pa.array(ids, id_type) if named is None else named
            i, j, d = best_of(q, unit(matrix(batch.column(at))), batch.column(at_tie).to_numpy(zero_copy_only=False), k)
            found = batch.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([named.take(pa.array(i)), pa.array(d), *(found.column(c) for c in kept)], names=[query, "distance", *kept])

    schema = ", ".join([f"`{query}` {kind}", "distance double", *(f"`{c}` {t}" for c, t in vectors.dtypes if c != embedding)])
    return first_of_each(vectors.mapInArrow(work, schema), k, query, tie)


def fan_out(
    vectors: DataFrame, query: list[float], group: str, k: int = 8, per_document: int | None = PER_DOCUMENT, document: list[str] | None = None,
    embedding: str = "embedding", tie: str = "vec_id",
) -> DataFrame:
    """A search of every group, merged: its nearest rows, at most ``per_document`` of a document, then ``k``. One scan and
    one window instead of a search each; the window sees what each Arrow batch's nearest rows of every group are."""
    fetch = k * FETCH if per_document else k
    w = Window.partitionBy(group).orderBy("distance", tie)
    near = _nearest_in_batches(vectors, query, group, fetch, embedding, tie)
    near = near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= fetch).drop("__n")
    return capped(near, k, per_document, document, tie, [group]) if per_document else near


def _distances(column: pa.ListArray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine distances of a column of vectors, and which are null: as ``cosine_distance`` says, for null or zero vectors,
    those of another length and those with null components. A row's distance depends on that row alone."""
    n, size = len(query), np.sqrt((query * query).sum())
    out, null = np.zeros(len(column)), np.ones(len(column), bool)
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == n)
    for at in range(0, len(rows), step := max(1, CELLS // max(n, 1))):
        some = rows[at : at + step]
        flat = column.take(pa.array(some)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        sizes = np.sqrt((x * x).sum(1)) * size
        gone = sizes <= 0
        if flat.null_count:
            gone |= ~flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(1)
        with np.errstate(all="ignore"):
            out[some], null[some] = 1 - (x * query).sum(1) / sizes, gone
    return out, null


def _nearest_in_batches(vectors: DataFrame, query: list[float], group: str, k: int, embedding: str, tie: str) -> DataFrame:
    """``vectors`` with distance: of each Arrow batch the ``k`` nearest rows of every group, ties by ``tie``, in the order
    of Spark's sorts (null distances first, NaN last)."""
    ship(vectors.sparkSession)
    q, names = np.array(query, np.float64), vectors.columns
    at, at_group, at_tie = names.index(embedding), names.index(group), names.index(tie)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, null = _distances(batch.column(at), q)
            place = np.where(null, -np.inf, np.where(np.isnan(d), np.inf, d))
            own = pc.fill_null(batch.column(at_group).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            ties = pc.rank(batch.column(at_tie), sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy()
            order = np.lexsort((ties, place, own))
            own = own[order]
            order = np.sort(order[np.arange(len(own)) - np.searchsorted(own, own) < k])
            found = batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(d[order], mask=null[order])], names=[*names, "distance"])

    return vectors.mapInArrow(work, ", ".join([*(f"`{c}` {t}" for c, t in vectors.dtypes), "distance double"]))


def empty_groups(dimension: DataFrame, hits: DataFrame, on: str) -> DataFrame:
    """Members of the dimension without a hit."""
    return dimension.join(hits.select(on).distinct(), on, "left_anti")


def narrowed(hits: DataFrame, ids: DataFrame, source: str = "proposal", document: str = "document_id") -> DataFrame:
    """Hits of ``source`` only if their document is among ``ids``; other sources pass."""
    wanted = ids.select(F.col(ids.columns[0]).alias(document)).distinct()
    return hits.where(F.col("source") == source).join(wanted, document, "left_semi").unionByName(hits.where(F.col("source") != source))


def norm_deviation(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    from palimpsest.functions.vectors import norm

    return vectors.agg(F.max(F.abs(1 - norm(F.col(embedding)))).alias("max_deviation"))
