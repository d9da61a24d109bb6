"""Repeated runs of lines: a suffix array of line ids by prefix doubling, in DataFrame operations alone.

Every line of every document begins a suffix of the corpus' line sequence. Ranks of suffixes by their first 1, 2, 4, 8 ...
lines come from prefix doubling: a window of 2^(k+1) lines sorts by the ranks of its halves, and a range-partitioned sort
of the pairs that occur gives the new ranks. Suffixes whose rank no other shares are in their final place and take no
further part, so only repeated lines are ever sorted. For each suffix L is the least number of lines that hold
``min_words`` words, forwards and backwards; its prefix of L lines has the ranks of two windows of 2^k <= L lines that
overlap to cover it, and doubling ends where no suffix has a longer L. The suffix array orders suffixes by these ranks, and
equal prefixes by place in the corpus. A suffix whose neighbour before it has the same ranks has a longest common prefix of
L lines or more with it: both lie in one interval of the array. Put together, the members of such intervals cover exactly
the maximal repeated runs of ``min_words`` words. The first member of an interval is the first in the corpus and stays;
all others are later copies and are deleted. The array is dealt out by ranges that split an interval of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

MIN_WORDS = 50


def _words(line: Column) -> Column:
    """Blanks plus one: what lines count towards a run, one at least."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """doc struct<id, t>, at, w, h1, h2: a row for each line; the text's digest tells apart documents that share an id."""
    lines = docs.where(F.length("text") > 0).select(
        F.struct("id", F.xxhash64("text").alias("t")).alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    return lines.select(
        "doc", "at", _words(F.col("line")).alias("w"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")
    )


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """``keys``, which occur once each, with c long: their places in the order of ``by``, from a range-partitioned sort."""
    sorted_ = cut(cut(keys).repartitionByRange(*by).withColumn("p", F.spark_partition_id()))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(*by))
    return sorted_.withColumn("at", place).join(starts, "p").select(*by, (F.col("start") + F.col("at")).alias("c"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc and drop array<int>: the lines, counted from 0, of later copies of runs of ``min_words`` words or more.

    ``docs`` has id and text. A run is any sequence of whole lines that occurs, line for line, at an earlier place: in a
    document of smaller id or further up in the same one. Only documents with such lines have a row.
    """
    shared = _lines(docs).groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2")
    level = _lines(docs).join(_ranked(shared, ["h1", "h2"]), ["h1", "h2"]).select("doc", "at", "w", "c")
    # Runs lie inside islands: lines in a row that all occur elsewhere, too.
    order = Window.partitionBy("doc").orderBy("at")
    island = F.col("at") - F.row_number().over(order)
    level = level.withColumn("isle", island)
    inside = Window.partitionBy("doc", "isle").orderBy("at")
    level = level.withColumn("sum", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.partitionBy("doc", "isle").orderBy(F.col("sum") - F.col("w")).rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc", "isle").orderBy("sum").rangeBetween(-(min_words - 1), 0)
    level = cut(
        level.select(
            "doc", "at", "w", "c", "sum",
            F.when(F.sum("w").over(ahead) >= min_words, F.count("*").over(ahead)).cast("int").alias("fwd"),
            F.when(F.sum("w").over(back) >= min_words, F.count("*").over(back)).cast("int").alias("bwd"),
        )
    )
    first = level.where("fwd is not null").select("doc", "at", F.col("fwd").alias("n"))
    last = level.where("bwd is not null").select("doc", (F.col("at") - F.col("bwd") + 1).alias("at"), F.col("bwd").alias("n"))
    # Level of the two halves that cover a window of n lines.
    exponent = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    wanted = cut(first.unionByName(last.where("bwd > 1")).distinct().withColumn("k", exponent))
    longest = wanted.agg(F.max("n")).first()[0] or 0

    ranks, now, k = None, level.select("doc", "at", "w", F.col("w").alias("w0"), F.col("w").alias("w1"), "c"), 0
    while longest:
        kept = now.select("doc", "at", F.lit(k).alias("k"), "c")
        ranks = kept if ranks is None else ranks.unionByName(kept)
        if 1 << (k + 1) > longest:
            break
        # w: words of the window; w0, w1: of its first and last line. A window that holds min_words without either of
        # them is longer than any that is wanted.
        right = now.select("doc", (F.col("at") - (1 << k)).alias("at"), F.col("w").alias("wr"), F.col("w1").alias("w1r"), F.col("c").alias("cr"))
        pairs = now.join(right, ["doc", "at"]).select(
            "doc", "at", (F.col("w") + F.col("wr")).alias("w"), "w0", F.col("w1r").alias("w1"), F.col("c").alias("cl"), "cr"
        )
        pairs = cut(pairs.where(F.col("w") - F.greatest("w0", "w1") < min_words))
        shared = pairs.groupBy("cl", "cr").agg(F.count("*").alias("m")).where("m > 1").select("cl", "cr")
        now = cut(pairs.join(_ranked(shared, ["cl", "cr"]), ["cl", "cr"]).select("doc", "at", "w", "w0", "w1", "c"))
        k += 1
    if ranks is None:
        return level.where("false").select("doc", F.array("at").alias("drop"))

    runs = wanted.join(ranks.withColumnRenamed("c", "cl"), ["doc", "at", "k"])
    tail = ranks.select("doc", F.col("at").alias("end"), "k", F.col("c").alias("cr"))
    runs = runs.withColumn("end", F.col("at") + F.col("n") - F.expr("shiftleft(1, k)"))
    runs = cut(runs.join(tail, ["doc", "end", "k"]).select("doc", "at", "n", "cl", "cr"))
    later = _copies(runs)
    lines = later.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    return lines.groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("drop"))


def _copies(runs: DataFrame) -> DataFrame:
    """The members of the array's intervals but the first of each. ``runs`` has doc, at, n, and the ranks cl and cr."""
    prefix, place = ["n", "cl", "cr"], ["doc", "at"]
    array = cut(runs.repartitionByRange(*prefix, *place).withColumn("p", F.spark_partition_id()))
    # The neighbour of a part's first suffix is the last one of the part before it that has any.
    before = Window.orderBy("p")
    edge = array.groupBy("p").agg(F.max(F.struct(*prefix, *place)).alias("last"))
    edge = edge.select("p", F.lag("last").over(before).alias("edge"))
    inside = Window.partitionBy("p").orderBy(*prefix, *place)
    array = array.withColumn("up", F.lag(F.struct(*prefix)).over(inside)).join(F.broadcast(edge), "p")
    up = F.coalesce("up", F.col("edge").dropFields(*place))
    return array.where(F.coalesce(up == F.struct(*prefix), F.lit(False))).select(*place, "n")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text without later copies of repeated line runs, n_lines int and dropped array<int> beside it.

    Lines are split at line feeds and compared whole; a line counts its blanks plus one as words, and a run needs
    ``min_words`` of them. The order of places is that of ids (nulls first), then lines. A document all of whose lines
    go has an empty text. Null and empty texts have no lines and stay as they are; rows with the same id and text are
    the same document and change alike. An empty table gives an empty result. Columns named n_lines, dropped, __i,
    __t, __drop or __lines in ``docs`` are an error; others stay.
    """
    if clash := {"n_lines", "dropped", "__i", "__t", "__drop", "__lines"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    found = repeated_lines(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), min_words)
    found = found.select(F.col("doc.id").alias("__i"), F.col("doc.t").alias("__t"), F.col("drop").alias("__drop"))
    same = F.col(id).eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(text)) == F.col("__t"))
    # Lines of changed texts only, and as a column of its own: within the lambda they'd be split anew for each stretch.
    lines = F.when(F.col("__drop").isNotNull(), F.split(F.col(text), "\n"))
    joined = docs.join(found, same, "left").withColumn("__lines", lines)
    at = lambda i: F.when(i == 0, -1).otherwise(F.get("__drop", i - 1))
    end = lambda i: F.coalesce(F.get("__drop", i), F.size("__lines"))
    stretch = F.transform(F.sequence(F.lit(0), F.size("__drop")), lambda i: F.slice("__lines", at(i) + 2, end(i) - at(i) - 1))
    kept = F.array_join(F.flatten(stretch), "\n")
    count = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1).otherwise(0)
    return joined.select(
        *(F.when(F.col("__lines").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns),
        count.cast("int").alias("n_lines"),
        F.coalesce("__drop", F.array().cast("array<int>")).alias("dropped"),
    )
