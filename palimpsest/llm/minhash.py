"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

Each shingle of a document owns a region as wide as its weight. Hashed darts fall on the plane of (weight, rank); those
inside a document's regions count, and each dart belongs to one of k coordinates. The earliest dart of every coordinate
is the signature: two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import components, cut, released
from palimpsest.shipping import ship

K, ROWS = 128, 5
BANDS = K // ROWS
WORDS = 5
SIMILAR = 0.8
#: Texts are worked on in slices of about so many bytes.
SLICE = 1 << 20
#: Two bits a coordinate estimate the similarity of a pair; pairs this far below the threshold are not read in full.
#: A pair right at the threshold is passed over about once in 140,000, less often than by the bands (once in 20,000).
AGREE = 90


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    return mix(np.array([n * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))[0]


_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_IN_WORD = np.array([chr(b).isalnum() or b >= 128 or b == 95 for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 4 * SLICE)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b)])) for b in (_BASE, _BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of all texts, ordered by both, each shingle once for each text.

    A word is a run of letters, digits, underscores or non-ASCII characters, in lower case. A text of fewer words than a
    shingle has one shingle of all its words; a text without words has none.
    """
    raws = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    n = len(data)
    ahead, back = _powers(n)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * ahead, dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    last = np.cumsum([len(r) + 1 for r in raws])
    doc = np.searchsorted(last, starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    m = len(word)
    at = np.arange(m)
    left = first[doc] + count[doc] - at
    keep = (left >= words) | (at == first[doc])
    where = at[keep]
    own = doc[where]
    gram = np.zeros(len(where), np.uint64)
    for j in range(words):
        ok = where + j < first[own] + count[own]
        part = mix(word[np.minimum(where + j, m - 1)] + salt(j + 1))
        gram += np.where(ok, part, np.uint64(0))
    gram = mix(gram)
    order = np.lexsort((gram, own))
    own, gram = own[order], gram[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])])
    places = np.flatnonzero(new)
    return own[places], gram[places], np.diff(np.concatenate([places, [len(own)]]))


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson count, for inversion."""
    out, p, total, k = [], float(np.exp(-mean)), 0.0, 0
    while k < mean + 12 * mean**0.5 + 16:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


_CDF: dict[int, np.ndarray] = {}


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rho: int, nu: int, k: int) -> tuple[np.ndarray, ...]:
    """Darts in cell (rank band rho, weight band nu) that hit the elements' regions: doc*k + coordinate, rank, name.

    Rank bands are [0,1), [1,2), [2,4) ...; weight bands the same; a cell has as many darts as its area on average.
    """
    low, high = (0.0 if rho == 0 else 2.0 ** (rho - 1)), 2.0**rho
    wide_low, wide_high = (0.0 if nu == 0 else 2.0 ** (nu - 1)), 2.0**nu
    area_log = max(rho - 1, 0) + max(nu - 1, 0)
    # Large cells are cut into parts of at most 64 darts on average, so that inversion stays exact.
    parts = 1 << max(0, area_log - 6)
    mean_log = min(area_log, 6)
    if mean_log not in _CDF:
        _CDF[mean_log] = _poisson(2.0**mean_log)
    found = []
    for part in range(parts):
        seed = mix(element ^ salt(1000 + (rho * 64 + nu) * 4096 + part))
        count = np.searchsorted(_CDF[mean_log], (seed >> np.uint64(11)).astype(float) * 2.0**-53, side="right")
        rows = np.repeat(np.arange(len(doc)), count)
        if not len(rows):
            continue
        number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        name = mix(seed[rows] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        spot = mix(name ^ np.uint64(0xD1B54A32D192ED03))
        rank = low + (high - low) * ((part + (spot >> np.uint64(11)).astype(float) * 2.0**-53) / parts)
        if nu or weight.min() < 1:
            across = wide_low + (wide_high - wide_low) * ((mix(spot) >> np.uint64(11)).astype(float) * 2.0**-53)
            hit = across < weight[rows]
            rows, name, rank = rows[hit], name[hit], rank[hit]
        coordinate = (mix(name + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)).astype(np.int64) % k
        found.append((doc[rows] * k + coordinate, rank, name))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """Names of the earliest dart of each of ``k`` coordinates, for documents 0 to docs-1; zeros for those without weight.

    Rank bands are thrown until every coordinate has a dart: as each band is complete, the earliest is exact.
    """
    weight = weight.astype(float)
    total = np.bincount(doc, weight, minlength=docs)
    out = np.zeros(docs * k, np.uint64)
    best = np.full(docs * k, np.inf)
    bands = int(np.ceil(np.log2(max(weight.max(), 1)))) + 1 if len(weight) else 0
    want = np.ceil(np.log2(np.maximum((k * np.log(k) + 2 * k) / np.maximum(total, 1e-9), 1)))
    todo, rho = total > 0, 0
    while todo.any():
        on = todo[doc]
        for nu in range(bands):
            own = on & (weight > (0 if nu == 0 else 2.0 ** (nu - 1)))
            if not own.any():
                continue
            key, rank, name = _throw(doc[own], element[own], weight[own], rho, nu, k)
            order = np.lexsort((rank, key))
            key, rank, name = key[order], rank[order], name[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            better = rank[first] < best[key[first]]
            first = first[better]
            best[key[first]], out[key[first]] = rank[first], name[first]
        short = np.isinf(best.reshape(docs, k)).any(axis=1)
        todo &= (rho < want) | short
        rho += 1
    return out.reshape(docs, k)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about ``size`` bytes of text, and their texts; a longer text is a slice of its own."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end, held = at, 0
            while end < batch.num_rows and (end == at or held + lens[end] <= size):
                held += lens[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            at = end


def _sum(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    whole = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return whole[places[1:]] - whole[places[:-1]]


def _occurrences(own: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element), an element for each occurrence of a shingle: the first is the shingle itself, later ones are
    told apart by number. The Jaccard similarity of such sets is the weighted one of the counts."""
    if (count == 1).all():
        return own, gram
    rows = np.repeat(np.arange(len(own)), count)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    element = np.where(number > 0, mix(gram[rows] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), gram[rows])
    return own[rows], element


def sketch(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, k1, k2 (name of the shingles and their counts), n (their sum), s0..s3 (two bits a coordinate), bands array<long>."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            own, gram, count = shingles(texts)
            n = len(texts)
            sig = signatures(own, gram, count, n)
            bands = sig[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
            key = mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            two = (sig & np.uint64(3)).reshape(n, 4, 32)
            short = np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=2)
            own, element = _occurrences(own, gram, count)
            places = np.searchsorted(own, np.arange(n + 1))
            size = np.diff(places)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array(_name(element, places, s)) for s in (7, 8)),
                    pa.array(size.astype(np.int32)),
                    *(pa.array(short[:, s].copy().view(np.int64)) for s in range(4)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[size > 0].reshape(-1).view(np.int64))),
                ],
                names=["id", "k1", "k2", "n", "s0", "s1", "s2", "s3", "bands"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        released(work), f"id {kind}, k1 long, k2 long, n int, s0 long, s1 long, s2 long, s3 long, bands array<long>"
    )


def _name(element: np.ndarray, places: np.ndarray, s: int) -> np.ndarray:
    return _sum(mix(element ^ salt(s)), places).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, node (the first name of the text's shingles) and its elements, an occurrence of a shingle each, array<long>;
    ``docs`` has id and text."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            own, element = _occurrences(*shingles(texts))
            places = np.searchsorted(own, np.arange(len(texts) + 1))
            grams = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(element.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_name(element, places, 7)), grams], names=["id", "node", "grams"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(released(work), f"id {kind}, node long, grams array<long>")


def _agreement(a: str, b: str) -> Column:
    """Coordinates, of 128, in which the two bits of both sides are the same."""
    odd = F.lit(0x5555555555555555)
    total = F.lit(K)
    for s in range(4):
        x = F.col(f"{a}s{s}").bitwiseXOR(F.col(f"{b}s{s}"))
        total = total - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return total


def _plausible(a: str, b: str) -> Column:
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return (_agreement(a, b) >= AGREE) & (small >= large * SIMILAR)


def _similar(a: str, b: str) -> Column:
    """Whether two sets have a Jaccard similarity of SIMILAR or more."""
    both = F.size(F.array_intersect(a, b))
    return both >= SIMILAR * (F.size(a) + F.size(b) - both) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").where(_similar("ga", "gb")).select("a", "b")


#: Pairs of a bucket of up to so many classes are told by name and checked after; a class is in few such pairs. Buckets
#: of more are compared within the join, which then gives links only, the one side of it in parts of so many.
SMALL, PART = 64, 1024


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, component (smallest id that links reach) and kept (id = component).

    Documents link if the weighted Jaccard similarity of their five-word shingles, each weighing as often as it occurs,
    is 0.8 or more. Equal weighted sets are one class from the start, so exact copies cost one row each whatever their
    number. Null texts, empty texts and texts without words link with nothing. Rows that share an id and differ in
    text are documents of their own; those with equal texts are alike. Null ids link with nothing. Other columns don't
    take part, and an empty table gives an empty result.

    Within a bucket of the banded join, each class first tries the one other that looks most like it among the buckets'
    smallest; most of a group of copies is joined then. Only classes that share a bucket and still lie in different
    components are then compared, those whose short sketches agree well enough: on one side of it all of the bucket, on
    the other what lies outside the bucket's smallest component.
    """
    sketches = cut(sketch(docs, id, text).where(F.col("id").isNotNull()))
    facts = ("n", "s0", "s1", "s2", "s3")
    named = sketches.where("n > 0").groupBy("k1", "k2")
    reps = cut(named.agg(F.min("id").alias("rep"), F.any_value(F.struct(*facts, "bands")).alias("f")))
    rows = reps.select(F.col("k1").alias("node"), F.explode("f.bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    own = reps.select(F.col("k1").alias("node"), F.col("rep").alias("id"), *(f"f.{c}" for c in facts))
    held = cut(rows.join(shared, "bucket").join(own, "node"))

    # The smallest id: of a group of copies it mostly is the one that the others are copies of, in every bucket.
    pivot = held.groupBy("bucket").agg(F.min(F.struct("id", "node", *facts)).alias("p"))
    tries = held.join(pivot, "bucket").where((F.col("node") != F.col("p.node")) & _plausible("", "p."))
    tries = tries.groupBy(F.col("node").alias("a")).agg(F.max(F.struct(_agreement("", "p.").alias("g"), F.col("p.node").alias("b"))).alias("t"))
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    candidates = held.select("id", "node").distinct()
    sets = shingle_sets(source.join(candidates.select("id").distinct(), "id", "left_semi"))
    sets = cut(sets.join(candidates, ["id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "grams"))
    linked = cut(_verified(tries.select("a", "t.b"), sets))

    first = components(linked)
    placed = cut(held.drop("id").join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket", "lo")
    rest = cut(placed.join(open_, "bucket"))
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c"))
    apart &= (F.col("y.c") == F.col("y.lo")) | (F.col("x.node") < F.col("y.node"))
    few = rest.where(F.col("m") <= SMALL)
    pairs = few.where("c <> lo").alias("x").join(few.alias("y"), apart & _plausible("x.", "y."))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    # A pair shares many buckets: the smallest of them is where it is compared. Both sides are dealt out as they are, for
    # adaptive execution would cut both sides of a hot bucket and run each pair of cuts as a task.
    many = rest.where(F.col("m") > SMALL).join(sets, "node").join(reps.select(F.col("k1").alias("node"), "f.bands"), "node")
    many = many.withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    left = many.where("c <> lo").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("bucket", "part")
    right = many.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).repartition("bucket", "part")
    owner = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
    linking = (F.col("x.part") == F.col("y.part")) & apart & _plausible("x.", "y.") & owner & _similar("x.grams", "y.grams")
    # One link of a class to each other component says as much as all.
    within = left.alias("x").join(right.alias("y"), linking).groupBy(F.col("x.node").alias("a"), F.col("y.c").alias("c"))
    within = within.agg(F.min("y.node").alias("b")).select("a", "b")
    groups = components(linked.unionByName(_verified(pairs, sets)).unionByName(within))

    classes = reps.select("k1", "k2", "rep").join(groups, reps["k1"] == groups["node"], "left").select("k1", "k2", "rep", F.coalesce("component", "k1").alias("c"))
    least = classes.groupBy("c").agg(F.min("rep").alias("component"))
    classes = classes.join(least, "c").select("k1", "k2", "component")
    found = sketches.join(classes, ["k1", "k2"], "left")
    # A row without words belongs to no class, though all such rows have one name.
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    told = found.select("id", component.alias("component"))
    alone = docs.where(F.col(id).isNull()).select(F.col(id).alias("id"), F.col(id).alias("component"))
    return told.unionByName(alone).select(F.col("id").alias(id), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
