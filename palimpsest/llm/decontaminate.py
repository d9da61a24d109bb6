"""Benchmark passages in documents, with edits: exact hits of pigeonhole pieces, then Myers' bit-parallel distance.

An item of m characters may differ by k = rate x m edits. Cut into k + 1 pieces, at least one piece of any passage within
that distance is unharmed, so an Aho-Corasick pass over the document finds every place worth measuring.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm.common import cut
from palimpsest.shipping import ship

RATE = 0.08
#: Characters of test items that one automaton holds; a larger benchmark is matched in several passes.
BLOCK = 1_000_000


def normal(text: str) -> str:
    """Lower case; whatever is no letter or digit becomes one space."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``pattern`` in ``text``, first of equals, if within ``most`` edits.

    One column of the edit matrix is held in two words of len(pattern) bits.
    """
    m = len(pattern)
    if not m:
        return None
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (min(m, most + 1), 0)
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise = (down | ~(horizontal | up)) & full
        fall = up & horizontal
        score += 1 if rise & top else -1 if fall & top else 0
        rise = rise << 1
        fall = fall << 1
        up = (fall | ~(vertical | rise)) & full
        down = rise & vertical & full
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best if best[0] <= most else None


@dataclass
class Matcher:
    """All pieces of some items in one automaton."""

    items: list[tuple[list, str, int]]  # ids, normalised text, error budget

    def build(self) -> None:
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, most) in enumerate(self.items):
            edges = [i * len(text) // (most + 1) for i in range(most + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, b))
        self.find = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.find.add_word(piece, places)
        self.find.make_automaton()

    def __getstate__(self) -> dict:
        return {"items": self.items}

    def matches(self, raw: str) -> list[tuple]:
        """(item id, edits, end in the normalised text) of every item in the text, the best place of each."""
        if not hasattr(self, "find"):
            self.build()
        text = normal(raw)
        if not text or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, places in self.find.iter(text):
            for n, b in places:
                starts.setdefault(n, set()).add(end + 1 - b)
        found = []
        for n, begins in starts.items():
            ids, item, most = self.items[n]
            if (at := text.find(item)) >= 0:
                best = (0, at + len(item))
            else:
                best = None
                # Neighbouring starts share a stretch of text, so each stretch is measured once.
                lo = hi = None
                for begin in [*sorted(begins), None]:
                    a, b = (begin - most, begin + len(item) + most) if begin is not None else (None, None)
                    if lo is not None and (a is None or a > hi):
                        base = max(lo, 0)
                        got = distance(item, text[base : max(hi, 0)], most)
                        if got and (best is None or got[0] < best[0]):
                            best = (got[0], base + got[1])
                        lo = None
                    if a is not None:
                        lo, hi = (a, b) if lo is None else (lo, max(hi, b))
            if best:
                found += [(i, *best) for i in ids]
        return sorted(found, key=lambda f: (f[0] is None, f))


#: Blocks of the benchmark that are matched in one pass, held by the driver and every worker at once.
HELD = 4


def matchers(benchmark: DataFrame, id: str = "item_id", text: str = "text", rate: float = RATE, block: int = BLOCK) -> Iterator[Matcher]:
    """Matchers that together hold all items, each of at most ``block`` characters or one item.

    Null texts and texts without letters or digits match nothing; items with equal normalised texts share their place.
    The items are brought to the driver one block's worth of ids at a time, as each matcher is asked for.
    """
    items = benchmark.where(F.length(text) > 0).select(F.col(id).alias("id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block))
    placed = items.withColumn("b", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for n in range(blocks):
        by: dict[str, list] = {}
        for row in (placed.where(F.col("b") == n) if blocks > 1 else placed).toLocalIterator():
            if key := normal(row.text):
                by.setdefault(key, []).append(row.id)
        held, length = [], 0
        for key in sorted(by):
            if held and length + len(key) > block:
                yield Matcher(held)
                held, length = [], 0
            held.append((sorted(by[key], key=lambda i: (i is None, i)), key, int(rate * len(key))))
            length += len(key)
        if held:
            yield Matcher(held)


def passes(benchmark: DataFrame, text: str = "text", id: str = "item_id", **options: object) -> Iterator[tuple[Column, Callable[[], None], bool]]:
    """A column of the benchmark items in ``text``, array of (item_id, edits, end), for each pass over the documents: of
    up to HELD blocks; what ends the pass and frees its blocks; and whether it is the last. Empty for null texts. One
    pass at least."""
    spark = benchmark.sparkSession
    ship(spark)
    kind = T.StructType([T.StructField("item_id", benchmark.schema[id].dataType), T.StructField("edits", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow = pa.list_(to_arrow_type(kind))

    def column(one: Matcher) -> tuple[Column, Callable[[], None]]:
        held = spark.sparkContext.broadcast(one)

        @F.arrow_udf(T.ArrayType(kind))
        def work(texts: pa.Array) -> pa.Array:
            me = held.value
            rows = (me.matches(t.as_py() or "") for t in texts)
            return pa.array([[{"item_id": i, "edits": e, "end": z} for i, e, z in r] for r in rows], arrow)

        return work(F.col(text)), held.unpersist

    found = matchers(benchmark, id, text, **options)
    group = list(islice(found, HELD))
    while True:
        after = list(islice(found, HELD))
        made = [column(one) for one in group]
        yield F.concat(F.array().cast(T.ArrayType(kind)), *(c for c, _ in made)), lambda made=made: [free() for _, free in made] and None, not after
        if not after:
            return
        group = after


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """id, item_id, edits, end: every benchmark item that a document holds within the item's error budget.

    ``end`` is the place, in the normalised text, where the best match ends. A row of ``docs`` that repeats gives its
    rows again; null and empty texts give none, nor do empty tables. Other columns don't take part. A benchmark of more
    than HELD blocks takes several passes; all but the last are written to the shared folder as they are made.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    parts = []
    for matched, free, last in passes(benchmark, "text", **options):
        found = rows.select("id", matched.alias("m")).select("id", F.explode("m").alias("m"))
        parts.append(found.select(F.col("id").alias(id), "m.item_id", "m.edits", "m.end"))
        if not last:
            parts[-1] = cut(parts[-1])
            free()
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; passes as for ``contaminated``."""
    for matched, free, last in passes(benchmark, text, **options):
        docs = docs.where(F.size(matched) == 0)
        if not last:
            docs = cut(docs)
            free()
    return docs
