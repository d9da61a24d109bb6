"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector v gets one more component, sqrt(M^2 - |v|^2), where M bounds all lengths; an anchor q gets 0. Then the squared
distance from q to v is |q|^2 + M^2 - 2 q.v: high scores are near, and a window of scores is an annulus around q. A tree
over a sample deals the rows into cells, an anchor goes to the cells that its annulus meets, and a tree in each cell is
searched nearest leaves first until the best k are nearer than all that is left. Distances only rule out, with room for
rounding; scores are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import vantage
from palimpsest.llm.codes import doubles, floors, usable
from palimpsest.llm.common import cut
from palimpsest.shipping import ship

#: Rows of each length that the tree of cells is grown from at most, and that give anchors their first bounds.
SAMPLE = 4096
#: Cells of a length at least; with more rows there are more, of about ROWS each. Cells that turn out larger (a group of
#: copies lies in one place) are dealt on by hash, and their anchors go to all parts.
CELLS, ROWS = 32, 32_768
#: Rows of a leaf; anchors that are searched together.
LEAF, BLOCK = 64, 256
#: Room for rounding, as a share of the greatest distance.
SLACK = 1e-6
#: What a long holds. Components from HUGE on (after scaling) have scores far beyond it.
LEAST, MOST, HUGE = -(1 << 63), (1 << 63) - 1, 1 << 45


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold integers where no inner product passes 2**53, else Python's integers."""
    whole = floors(x, scale)
    if whole.dtype != object:
        most = float(np.abs(whole).max()) if whole.size else 0.0
        if most * most * max(1, x.shape[1]) < 2.0**53:
            return whole.astype(np.float64)
        out = np.empty(whole.size, object)
        out[:] = whole.ravel().tolist()
        return out.reshape(whole.shape)
    return whole


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    if a.dtype != b.dtype:
        a, b = _exact(a), _exact(b)
    return a @ b.T


def _exact(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return x
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def _norms(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1).astype(np.float64) if x.shape[1] else np.zeros(len(x))


def _text(score: float) -> str:
    return str(score) if isinstance(score, float) and np.isinf(score) else str(int(score))


@dataclass
class Held:
    """Rows that a task holds, in a tree: ``m2`` is M squared."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    m2: float
    leaf: int = LEAF

    def __post_init__(self) -> None:
        self.norms = _norms(self.x)
        self.up = np.sqrt(np.maximum(self.m2 - self.norms, 0))
        self.order = np.empty(len(self.id), np.int64)  # each row's place by id
        self.order[np.argsort(self.id, kind="stable")] = np.arange(len(self.id))
        self.root = vantage.grow(np.arange(len(self.id)), self.far, self.leaf)
        self.flat = vantage.Flat(self.root)

    def far(self, i: int, some: np.ndarray) -> np.ndarray:
        return self.away(self.x[i], self.norms[i], self.up[i], self.x[some], self.norms[some], self.up[some])

    @staticmethod
    def away(p: np.ndarray, pn: float, pu: float, x: np.ndarray, norms: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Distances of augmented vectors."""
        inner = _dot(x, p[None])[:, 0].astype(np.float64)
        return np.sqrt(np.maximum(norms + pn - 2 * inner + (up - pu) ** 2, 0))


@dataclass
class Asked:
    """Windows of scores, each of one anchor (``owner``): the best ``k`` in it are wanted."""

    q: np.ndarray
    id: np.ndarray
    label: np.ndarray
    owner: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def radius(self, score: np.ndarray, m2: float) -> np.ndarray:
        """How far from its anchor a row of this score lies."""
        return np.sqrt(np.maximum(_norms(self.q)[self.owner] + m2 - 2 * score.astype(np.float64), 0))


def _reach(flat: vantage.Flat, distances: np.ndarray, asked: Asked, inner: np.ndarray, outer: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves each window's annulus can meet, and the leaves' least distances from each anchor. What can't be
    compared, as it passes the range of doubles, isn't ruled out."""
    lower, upper = flat.bounds(distances)
    room = SLACK * (np.sqrt(m2) + np.sqrt(_norms(asked.q)))[asked.owner]
    out = (lower[asked.owner] > (outer + room)[:, None]) | (upper[asked.owner] < (inner - room)[:, None])
    return ~out, lower


def best(held: Held, asked: Asked, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each window by score, then id: (window, score, row), in order.

    Rows of the anchor's label (``same``) or of others count, never rows of the anchor's id. The tree's points are
    looked at first; then each anchor's leaves, nearest first, in steps that double: a leaf is looked at as long as a
    row of it could be among the window's best.
    """
    m2, x, least = held.m2, held.x, asked.lo.copy()
    inner, outer = asked.radius(asked.hi, m2), asked.radius(asked.lo, m2)
    points = np.array(held.flat.points, np.int64)
    scores = _dot(asked.q, x[points])
    if scores.dtype == object:
        least = least.astype(object)
    distances = np.sqrt(np.maximum(_norms(asked.q)[:, None] + m2 - 2 * scores.astype(np.float64), 0)) if len(points) else np.zeros((len(asked.q), 0))
    viable, lower = _reach(held.flat, distances, asked, inner, outer, m2)
    room = SLACK * (np.sqrt(m2) + np.sqrt(_norms(asked.q)))[asked.owner]
    w, s, r = (np.zeros(0, np.int64), np.zeros(0, scores.dtype), np.zeros(0, np.int64))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(windows: np.ndarray, rows: np.ndarray, known: np.ndarray | None = None) -> None:
        u, back = np.unique(asked.owner[windows], return_inverse=True)
        got = (_dot(asked.q[u], x[rows]) if known is None else known[u])[back]
        ok = (got >= least[windows, None]) & (got <= asked.hi[windows, None])
        ok &= (held.label[rows] == asked.label[asked.owner[windows], None]) == same
        ok &= held.id[rows] != asked.id[asked.owner[windows], None]
        i, j = np.nonzero(ok.astype(bool))
        if len(i):
            found.append((windows[i], got[i, j], rows[j]))

    def settle() -> None:
        nonlocal w, s, r
        if not found:
            return
        a, b, c = (np.concatenate(z) for z in zip((w, s, r), *found, strict=True))
        found.clear()
        order = np.lexsort((held.order[c], -b, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff([*first, len(a)]))
        keep = rank < k
        w, s, r = a[keep], b[keep], c[keep]
        last = rank == k - 1
        least[a[last]] = b[last]
        outer[a[last]] = np.minimum(outer, asked.radius(least, m2))[a[last]]

    everyone = np.arange(len(asked.owner))
    if len(points):
        look(everyone, points, scores)
        settle()
    order = np.argsort(lower, axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    start, step = 0, 1
    while start < len(held.flat.leaves):
        now = viable & (turn[asked.owner] >= start) & (turn[asked.owner] < start + step)
        now &= ~(lower[asked.owner] > (outer + room)[:, None])
        for leaf in np.flatnonzero(now.any(0)):
            look(np.flatnonzero(now[:, leaf]), held.flat.leaves[leaf])
        settle()
        start, step = start + step, 2 * step
    return w, s, r


@dataclass
class Cells:
    """For vectors of one length: the first of its cells' numbers, and the tree over sampled rows that deals them out."""

    base: int
    sample: Held

    @property
    def n(self) -> int:
        return len(self.sample.flat.leaves)

    def place(self, x: np.ndarray) -> np.ndarray:
        s, norms = self.sample, _norms(x)
        up = np.sqrt(np.maximum(s.m2 - norms, 0))
        return self.base + vantage.dealt(s.root, len(x), lambda p, at: s.away(s.x[p], s.norms[p], s.up[p], x[at], norms[at], up[at]))

    def visits(self, asked: Asked, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which cells each anchor goes to, and its windows' lower ends as the sample's rows raise them: where the
        sample has ``k`` rows in a window, the best lie no farther away."""
        s = self.sample
        w, score, _ = best(s, asked, k, same)
        least = asked.lo.astype(object) if score.dtype == object else asked.lo.copy()
        at, n = np.unique(w, return_counts=True)
        ends = np.cumsum(n) - 1
        least[at[n == k]] = score[ends[n == k]]
        points = np.array(s.flat.points, np.int64)
        distances = np.sqrt(np.maximum(_norms(asked.q)[:, None] + s.m2 - 2 * _dot(asked.q, s.x[points]).astype(np.float64), 0)) if len(points) else np.zeros((len(asked.q), 0))
        opened = vantage.Flat(vantage.opened(s.root))
        windows, _ = _reach(opened, distances, asked, asked.radius(asked.hi, s.m2), asked.radius(least, s.m2), s.m2)
        cells = np.zeros((len(asked.q), self.n), bool)
        np.logical_or.at(cells, asked.owner, windows & (least <= asked.hi)[:, None].astype(bool))
        return cells, least


def hard_negatives(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of
    other labels whose score lies between ``window`` percent of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * component); higher ones come first, ties by smaller id. A negative
    positive_score leaves an empty window, one of 0 only scores of 0. ``anchors`` is a condition on ``rows``.

    Rows with a null id, label or vector, or with null or non-finite components, take no part, nor do those with a
    component of 2**45 or more after scaling, whose scores no long could hold. Only vectors of the same
    length are compared; those without components score 0. Rows that share an id are rows of their own, but never
    positives or negatives of an anchor of that id. Scores beyond a long are compared exactly and shown as the nearest
    long. Other columns don't matter; an empty table gives no rows.

    What leaves a task are at most ``positives`` (``negatives``) rows for each anchor (window) and part that it visits.
    Rows are written to the shared folder once, with the cell each lies in; both searches read them there.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = {c: t for c, t in rows.dtypes}
    id_kind, label_kind = kinds[id], kinds[label]
    out = f"anchor_id {id_kind}, positive_id {id_kind}, rank int, negative_id {id_kind}, positive_score long, negative_score long"
    own = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    own = own.where(F.forall("v", lambda x: F.abs(x.cast("double")) * scale < HUGE))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), F.lit(2.0)))
    widths = {r.width: (r.n, r.m2) for r in own.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(size).alias("m2")).collect()}
    if not widths:
        return spark.createDataFrame([], out)
    cells: dict[int, Cells] = {}
    base = 0
    for width, (n, m2) in sorted(widths.items()):
        some = own.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id", "label", "v").limit(SAMPLE).select("id", "label", "v").collect()
        x = integers(np.array([r.v for r in some], np.float64).reshape(len(some), width), scale)
        leaf = max(1, len(some) // max(CELLS, min(SAMPLE // 4, -(-n // ROWS))))
        bound = float(np.float64(m2) * (1 + 1e-9) + 1e-300)
        cells[width] = Cells(base, Held(np.array([r.id for r in some]), np.array([r.label for r in some]), x, bound, leaf))
        base += cells[width].n
    held = spark.sparkContext.broadcast(cells)
    kind = "<f8" if kinds[vector] == "array<double>" else "<f4"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4 * BLOCK):
                some = whole.slice(start, 4 * BLOCK)
                for at, x in doubles(some.column(2)):
                    batch = some.take(pa.array(at))
                    raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                    where = pa.array(held.value[x.shape[1]].place(integers(x, scale)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], raw, batch.column(3), batch.column(4), where], names=["id", "label", "x", "anchor", "uid", "cell"])

    placed = own.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(place, f"id {id_kind}, label {label_kind}, x binary, anchor boolean, uid long, cell int")
    placed = cut(placed)
    parts = {r.cell: -(-r["count"] // ROWS) for r in placed.groupBy("cell").count().collect()}
    total = sum(parts.values())
    spread = spark.sparkContext.broadcast(parts)
    width_of = {c: w for w, one in cells.items() for c in range(one.base, one.base + one.n)}

    many = F.create_map(*(F.lit(v) for cell, n in parts.items() if n > 1 for v in (cell, n))) if any(n > 1 for n in parts.values()) else None
    among = F.coalesce(many[F.col("cell")], F.lit(1)) if many is not None else F.lit(1)
    entries = placed.select("cell", F.pmod(F.xxhash64("uid"), among).cast("int").alias("part"), F.lit(0).alias("role"), "uid", "id", "label", "x", F.lit(None).cast("array<string>").alias("windows"))
    wire = f"cell int, part int, role int, uid long, id {id_kind}, label {label_kind}, x binary, windows array<string>"

    def vectors(column: pa.Array, width: int) -> np.ndarray:
        return integers(np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), width), scale)

    def asked(batch: pa.RecordBatch, width: int) -> Asked:
        """Anchors with their windows: texts ``lo,hi``, as scores may pass a long."""
        texts = batch.column("windows").to_pylist()
        ends = [tuple(float(e) if "inf" in e else int(e) for e in t.split(",")) for ts in texts for t in ts]
        wide = any(abs(e) >= 2.0**53 and abs(e) != float("inf") for pair in ends for e in pair)
        lo, hi = (np.array([e[i] for e in ends], object if wide else np.float64) for i in (0, 1))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        return Asked(vectors(batch.column("x"), width), ids, labels, owner, lo, hi)

    def search(queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The best of each window in each part: (uid, window, score, id). ``queries``: uid, id, label, x, windows."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                sizes = np.array([len(b) for b in whole.column("x").to_pylist()]) // np.dtype(kind).itemsize
                for width in np.unique(sizes):
                    mine = whole.take(pa.array(np.flatnonzero(sizes == width)))
                    one = held.value[int(width)]
                    for start in range(0, mine.num_rows, BLOCK):
                        batch = mine.slice(start, BLOCK)
                        want = asked(batch, int(width))
                        visits, least = one.visits(want, k, same)
                        texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
                        for o, a, b in zip(want.owner, least, want.hi, strict=True):
                            texts[o].append(f"{_text(a)},{_text(b)}")
                        who, where = np.nonzero(visits)
                        pairs = [(q, one.base + c, p) for q, c in zip(who, where, strict=True) for p in range(spread.value.get(one.base + int(c), 0))]
                        if not pairs:
                            continue
                        q, c, p = (np.array(z) for z in zip(*pairs, strict=True))
                        out = batch.take(pa.array(q))
                        columns = [pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(np.ones(len(q), np.int32)), *(out.column(n) for n in ("uid", "id", "label", "x"))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([texts[i] for i in q], pa.list_(pa.string()))], names=[f.split()[0] for f in wire.split(", ")])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, gathered, tree = None, [], None
            for whole in batches:
                at, part, roles = (whole.column(n).to_numpy() for n in ("cell", "part", "role"))
                turns = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (roles[1:] != roles[:-1])]))
                for a, b in zip(turns, [*turns[1:], whole.num_rows], strict=True):
                    here = (int(at[a]), int(part[a]))
                    if roles[a] == 0:
                        if now != here:
                            now, gathered, tree = here, [], None
                        gathered.append(whole.slice(a, b - a))
                        continue
                    if now != here:
                        continue  # a part of a cell that got no rows
                    width = width_of[here[0]]
                    if tree is None:
                        t = pa.Table.from_batches(gathered).combine_chunks()
                        ids, labels = (t[n].combine_chunks().to_numpy(zero_copy_only=False) for n in ("id", "label"))
                        tree, gathered = Held(ids, labels, vectors(t["x"].combine_chunks(), width), held.value[width].sample.m2), []
                    for start in range(a, b, BLOCK):
                        batch = whole.slice(start, min(BLOCK, b - start))
                        want = asked(batch, width)
                        w, score, r = best(tree, want, k, same)
                        if not len(w):
                            continue
                        first = np.searchsorted(want.owner, np.arange(batch.num_rows))
                        columns = [
                            batch.column("uid").take(pa.array(want.owner[w])), pa.array((w - first[want.owner[w]]).astype(np.int32)),
                            pa.array([_text(v) for v in score], pa.string()), pa.array(tree.id[r].tolist(), batch.schema.field("id").type),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["uid", "window", "score", "id"])

        sent = queries.mapInArrow(route, wire)
        both = entries.unionByName(sent).repartition(max(1, min(total, 20_000)), "cell", "part").sortWithinPartitions("cell", "part", "role")
        got = both.mapInArrow(answer, f"uid long, window int, score string, id {id_kind}").withColumn("score", F.col("score").cast("decimal(38,0)"))
        place = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
        return got.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    asking = placed.where("anchor").select("uid", "id", "label", "x")
    near = cut(search(asking.withColumn("windows", F.array(F.lit("-inf,inf"))), positives, True).select("uid", "rank", F.col("id").alias("positive_id"), "score"))
    low, high = window
    lo = -F.floor(-low * F.col("score") / 100)
    hi = F.floor(high * F.col("score") / 100)
    wanted = near.where(F.col("score") >= 0).withColumn("text", F.concat_ws(",", lo.cast("decimal(38,0)").cast("string"), hi.cast("decimal(38,0)").cast("string")))
    wanted = wanted.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "positive_id", "score"))).alias("found"))
    windows = asking.join(wanted, "uid").select("uid", "id", "label", "x", F.col("found.text").alias("windows"))
    found = search(windows, negatives, False).select("uid", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asking.select("uid", F.col("id").alias("anchor_id")).join(wanted.select("uid", "found"), "uid")
    fit = lambda c: F.greatest(F.least(c, F.lit(MOST).cast("decimal(38,0)")), F.lit(LEAST).cast("decimal(38,0)")).cast("long")
    return found.join(named, "uid").select(
        "anchor_id", F.col("found")[F.col("window")]["positive_id"].alias("positive_id"), "rank", "negative_id",
        fit(F.col("found")[F.col("window")]["score"]).alias("positive_score"), fit(F.col("negative_score")).alias("negative_score"),
    )
