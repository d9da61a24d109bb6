"""Reports over documents, threads and stored chunks: joins by ids inside links, counts, set differences, checks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a link names its host, and the number of what it leads to.
HOST, NUMBER = r"^[a-z]+://([^/]+)/", r"/([0-9]+)"


def linked(documents: DataFrame, link: str, targets: DataFrame, target_id: str, host: str = "host") -> DataFrame:
    """Documents with the target that the number in their link names, and the link's host. Links without a number, or with
    one that is no id, have no row; the number is read once and the join is by equality."""
    held = documents.withColumns({host: F.regexp_extract(link, HOST, 1), "__id": F.regexp_extract(link, NUMBER, 1).try_cast("bigint")})
    return held.join(targets, F.col("__id") == targets[target_id]).drop("__id")


def volume(joined: DataFrame, by: list[str], rows: str = "rows", **distinct: str) -> DataFrame:
    """Rows of each group and, by name, how many different values a column has there."""
    return joined.groupBy(*by).agg(F.count("*").alias(rows), *(F.count_distinct(c).alias(name) for name, c in distinct.items()))


def busiest(posts: DataFrame, thread: str, k: int = 10) -> DataFrame:
    """The ``k`` threads with most posts, ties by thread. Only a row for each thread is compared."""
    return posts.groupBy(thread).agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), thread).limit(k)


def by_scheme(chunks: DataFrame, scheme: str = "chunk_scheme") -> DataFrame:
    """How many chunks are stored of each scheme: more than one means that a change of chunking left old ones."""
    return chunks.groupBy(F.col(scheme).alias("chunk_scheme")).agg(F.count("*").alias("n"))


def missed(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were expected and not found, each once."""
    return expected.select(*keys).subtract(found.select(*keys))


def lacks_prefix(text: Column, *prefixes: str) -> Column:
    """Whether a text begins with none of these; null for null."""
    found = F.lit(False)
    for p in prefixes:
        found = found | text.startswith(p)
    return ~found


def lacks_start_of(text: Column, title: Column, n: int = 12) -> Column:
    """Whether a text holds the first ``n`` characters of a title nowhere."""
    return F.position(F.substring(title, 1, n), text) == 0


def mentions(text: Column, word: str) -> Column:
    """Whether a text holds a word in any case."""
    return F.lower(text).contains(word.lower())
