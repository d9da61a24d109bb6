"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table look-ups, exact rerank.

Each vector lies in the list of its nearest coarse centroid, as codes of its residual's parts. A vector probes the lists
of its nearest centroids, as many as the sample shows copies of it to need. Distances to a list come from tables of a
probe's parts and the codebook; whatever they, and the error that each code is known to have, cannot rule out is compared
exactly. So only the choice of lists can lose a link.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import components, cut
from palimpsest.shipping import ship

SIMILAR = 0.9
#: Vectors that the quantiser is fitted on at most.
SAMPLE = 20_000
#: Lists that a vector probes at least. There are more where this share of the sample's copies at the threshold (turned
#: towards other vectors), or of its own links, would else be missed.
PROBES = 8
FOUND, FOUND_REAL = 0.99, 0.999
#: Centroids nearer to each other than this share a dense group: one of them stands for it.
CLOSE = 0.25
#: Entries of a list that one task holds; larger lists are split and probes go to every part.
PART = 4096
PARTS, CODES = 16, 64


@dataclass
class Quantiser:
    coarse: np.ndarray
    books: list[np.ndarray]  # by part: codes x width
    edges: list[int]
    probes: int = 1

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the vectors' own squares."""
        return (self.coarse * self.coarse).sum(1) - 2 * x @ self.coarse.T

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest list, lists to probe, codes and coding error of unit vectors."""
        d = self.far(x)
        own, n = d.argmin(1), min(self.probes, len(self.coarse))
        d[np.arange(len(x)), own] = -np.inf
        probes = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(self.coarse) else np.tile(np.arange(n), (len(x), 1))
        rest = x - self.coarse[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for k, book in enumerate(self.books):
            part = rest[:, self.edges[k] : self.edges[k + 1]]
            dist = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            codes[:, k] = dist.argmin(1)
            error += ((part - book[codes[:, k]]) ** 2).sum(1)
        return own, probes, codes, np.sqrt(error)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 2048] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for i in range(0, len(x), 2048)])
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(k))
        n = np.bincount(own, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def _spread(c: np.ndarray) -> np.ndarray:
    """The centroids but for those closer than CLOSE to one before them."""
    keep = np.ones(len(c), bool)
    for i in range(len(c)):
        if keep[i]:
            keep[i + 1 :] &= ((c[i + 1 :] - c[i]) ** 2).sum(1) >= CLOSE**2
    return c[keep]


def _probes(x: np.ndarray, q: Quantiser, rng: np.random.Generator, rows: int = 4000) -> int:
    """How many lists to probe, so that one of two vectors that link mostly probes the other's."""

    def needs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        da, db, at = q.far(a), q.far(b), np.arange(len(a))
        la, lb = da.argmin(1), db.argmin(1)
        return 1 + np.minimum((da < da[at, lb][:, None]).sum(1), (db < db[at, la][:, None]).sum(1))

    some = rng.permutation(len(x))[:rows]
    copies, real = [], []
    for i in range(0, len(some), 256):
        part = x[some[i : i + 256]]
        y = x[rng.integers(0, len(x), len(part))]
        y = y - (y * part).sum(1, keepdims=True) * part
        size = np.sqrt((y * y).sum(1, keepdims=True))
        turned = (SIMILAR * part + np.sqrt(1 - SIMILAR**2) * y / np.maximum(size, 1e-9))[size[:, 0] > 1e-9]
        copies.append(needs(part[size[:, 0] > 1e-9], turned))
        cosine = part @ x.T
        cosine[np.arange(len(part)), some[i : i + 256]] = 0
        a, b = np.nonzero(cosine >= SIMILAR)
        pick = rng.permutation(len(a))[:2048]
        real.append(needs(part[a[pick]], x[b[pick]]))
    shares = ((np.concatenate(copies), FOUND), (np.concatenate(real), FOUND_REAL))
    return max([PROBES, *(int(np.quantile(n, f, method="higher")) for n, f in shares if len(n))])


def fit(x: np.ndarray, lists: int, seed: int = 5) -> Quantiser:
    """A quantiser from sampled unit vectors."""
    rng = np.random.default_rng(seed)
    coarse = _spread(_means(x, lists, rng))
    made = Quantiser(coarse, [], [])
    rest = x - coarse[np.concatenate([made.far(x[i : i + 2048]).argmin(1) for i in range(0, len(x), 2048)])]
    parts = min(PARTS, x.shape[1])
    made.edges = [i * x.shape[1] // parts for i in range(parts + 1)]
    made.books = [_means(rest[:, a:b], CODES, rng) for a, b in zip(made.edges, made.edges[1:], strict=False)]
    made.probes = _probes(x, made, rng)
    return made


@dataclass
class Index:
    """A quantiser for each length of vectors that the sample has. Lists are numbered through all of them; those of a
    length without a quantiser are one list, of a negative number."""

    known: dict[int, tuple[int, Quantiser]]

    @classmethod
    def fit(cls, sample: list[list[float]], n: int) -> Index:
        by: dict[int, list[list[float]]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        known, base = {}, 0
        for width, rows in sorted(by.items()):
            there = n * len(rows) / len(sample)
            one = fit(unit(np.array(rows, np.float64)), int(max(1, min(4096, len(rows) // 8 + 1, round(2 * there**0.5)))))
            known[width] = (base, one)
            base += len(one.coarse)
        return cls(known)

    def of_width(self, width: int) -> tuple[int, Quantiser]:
        if width not in self.known:
            return -width, Quantiser(np.zeros((1, width)), [np.zeros((1, width))], [0, width])
        return self.known[width]

    def of_list(self, which: int) -> tuple[int, Quantiser]:
        if which < 0:
            return self.of_width(-which)
        found = sorted(self.known.values(), key=lambda k: k[0])
        return found[bisect_right([base for base, _ in found], which) - 1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1))


def links_within(quantiser: Quantiser, which: int, entries: dict[str, np.ndarray], probes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe row, entry row) of a list at cosine SIMILAR or more: table look-up first, exact then."""
    c = quantiser.coarse[which]
    rest = probes["x"] - c
    d = np.zeros((len(rest), len(entries["x"])), np.float32)
    for k, book in enumerate(quantiser.books):
        part = rest[:, quantiser.edges[k] : quantiser.edges[k + 1]]
        table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
        d += table.astype(np.float32)[:, entries["codes"][:, k]]
    reach = np.sqrt(2 - 2 * SIMILAR) + entries["error"]
    q, e = np.nonzero(d <= (reach**2 + 1e-4).astype(np.float32))
    keep = probes["id"][q] != entries["id"][e]
    q, e = q[keep], e[keep]
    good = np.zeros(len(q), bool)
    for at in range(0, len(q), 65536):
        s = slice(at, at + 65536)
        good[s] = np.einsum("ij,ij->i", probes["x"][q[s]], entries["x"][e[s]]) >= SIMILAR
    return q[good], e[good]


def _forest(q: np.ndarray, e: np.ndarray, probes: int, entries: int) -> np.ndarray:
    """Pairs, of those given, that join the same rows with the fewest: a spanning forest."""
    label = np.arange(probes + entries)
    pick = np.zeros(len(q), bool)
    rest = np.arange(len(q))
    while len(rest):
        a, b = label[q[rest]], label[probes + e[rest]]
        apart = a != b
        rest, a, b = rest[apart], a[apart], b[apart]
        if not len(rest):
            break
        # Every label of the larger kind joins one smaller neighbour; no circle can arise.
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        top, first = np.unique(hi, return_index=True)
        pick[rest[first]] = True
        new = np.arange(len(label))
        new[top] = lo[first]
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
    return np.flatnonzero(pick)


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``vectors``: id, n_links long, component (smallest id that links reach), kept.

    Two vectors of the same length link at a cosine of 0.9 or more in double precision. Vectors that are null or zero, or
    hold null or non-finite components, link with nothing. Equal vectors are one entry with a weight from the start, and
    their copies link with each other; rows that share an id are taken to be different vectors of one document. Other
    columns don't take part; an empty table gives an empty result.

    A list's entries are held in parts of PART; its probes stream past them. A task reports counts of links and a
    spanning forest of each block, never the pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    width = 8 if dict(vectors.dtypes)[vector] == "array<double>" else 4
    kind = "<f8" if width == 8 else "<f4"
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    named = rows.where("id is not null").withColumn("ok", F.coalesce(whole, F.lit(False)))
    named = named.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "v")))
    classes = cut(named.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w")))
    reps = named.where("ok").join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"]).select("id", "v", "w")
    n = classes.count()

    def done(counts: DataFrame | None, groups: DataFrame | None) -> DataFrame:
        known = named.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left")
        if counts is None:
            known = known.withColumn("n", F.lit(0)).withColumn("c", F.col("rep"))
        else:
            known = known.join(counts, known["rep"] == counts["of"], "left").drop("of")
            known = known.join(groups, known["rep"] == groups["node"], "left").drop("node").withColumn("c", F.coalesce("component", "rep"))
        lone = rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
        own = known.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component"))
        return own.unionByName(lone).select(F.col("id").alias(id), "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

    share = min(1.0, 0.97 * sample / max(n, 1))
    picked = reps.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share)).select("id", "v").limit(sample)
    seen = sorted((r.id, r.v) for r in picked.collect())
    if n < 2 or not seen:
        return done(None, None)
    held = spark.sparkContext.broadcast(Index.fit([v for _, v in seen], n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "w", "x", "own", "probes", "codes", "error"]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                widths = np.diff(some.column(1).offsets.to_numpy())
                for width in np.unique(widths):
                    batch = some.take(pa.array(np.flatnonzero(widths == width)))
                    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                    raw = [r.tobytes() for r in flat.reshape(batch.num_rows, -1)]
                    base, quantiser = held.value.of_width(int(width))
                    own, probes, codes, error = quantiser.place(_unit(raw, kind))
                    sizes = np.arange(len(own) + 1) * probes.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array((base + probes).astype(np.int32).ravel()))
                    columns = [pa.array(raw, pa.binary()), pa.array((base + own).astype(np.int32)), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    id_kind = rows.schema["id"].dataType.simpleString()
    placed = cut(reps.mapInArrow(place, f"id {id_kind}, w long, x binary, own int, probes array<int>, codes binary, error double"))
    parts = placed.groupBy("own").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    entries = placed.join(parts, "own").select(
        F.col("own").alias("list"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "id", "w", "x", "own", "probes", "codes", "error"
    )
    sent = placed.select("id", "w", "x", "own", F.explode("probes").alias("list")).join(parts.withColumnRenamed("own", "list"), "list")
    sent = sent.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "id", "w", "x", "own",
        F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, now = held.value, None
        entries: dict[str, np.ndarray] | None = None
        gathered: list[pa.RecordBatch] = []

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # No b: a count of a's links. No n: a link.
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], names=["a", "b", "n"])

        def finish(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
            table = pa.Table.from_batches(parts)
            probes = table["probes"].combine_chunks()
            sizes = np.diff(probes.offsets.to_numpy())
            rows = np.repeat(np.arange(table.num_rows), sizes)
            keys = (rows.astype(np.int64) << 32) + probes.flatten().to_numpy()
            return {
                "id": table["id"].to_numpy(), "w": table["w"].to_numpy(), "x": _unit(table["x"].to_pylist(), kind),
                "codes": np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, -1),
                "error": table["error"].to_numpy(), "keys": np.sort(keys),
            }

        for whole in batches:
            lists, places, roles = (whole.column(k).to_numpy() for k in range(3))
            turns = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (places[1:] != places[:-1]) | (roles[1:] != roles[:-1])]))
            for a, b in zip(turns, [*turns[1:], whole.num_rows], strict=True):
                group = (int(lists[a]), int(places[a]))
                if roles[a] == 0:
                    if now != group:
                        now, entries, gathered = group, None, []
                    gathered.append(whole.slice(a, b - a))
                    continue
                if now != group:
                    continue  # probes of a list without entries in this part
                entries = entries or finish(gathered)
                gathered = []
                base, quantiser = me.of_list(group[0])
                for at in range(a, b, 256):
                    batch = whole.slice(at, min(256, b - at))
                    own = batch.column(6).to_numpy()
                    probes = {"id": batch.column(3).to_numpy(), "w": batch.column(4).to_numpy(), "x": _unit(batch.column(5).to_pylist(), kind)}
                    q, e = links_within(quantiser, group[0] - base, entries, probes)
                    if not len(q):
                        continue
                    links = np.bincount(q, entries["w"][e], len(own)).astype(np.int64)
                    hit = np.flatnonzero(links)
                    yield out(probes["id"][hit], probes["id"][hit], links[hit])
                    # The other way round is found in the probe's own list if the entry probes that; else it counts here.
                    back = ~np.isin((e.astype(np.int64) << 32) + own[q], entries["keys"])
                    links = np.bincount(e[back], probes["w"][q[back]], len(entries["id"])).astype(np.int64)
                    hit = np.flatnonzero(links)
                    yield out(entries["id"][hit], entries["id"][hit], links[hit])
                    few = _forest(q, e, len(own), len(entries["id"]))
                    yield out(probes["id"][q[few]], entries["id"][e[few]], np.zeros(len(few), np.int64))

    both = entries.unionByName(sent).repartition("list", "part").sortWithinPartitions("list", "part", "role")
    found = cut(both.mapInArrow(compare, f"a {id_kind}, b {id_kind}, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    return done(counts, components(found.where("n = 0").select("a", "b")))
