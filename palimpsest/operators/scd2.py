"""Slowly changing versions: first observations, validity windows, as-of access, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_observations(observations: DataFrame, keys: list[str], record: str = "record_hash", observed: str = "observed_at", keep: str = "first") -> DataFrame:
    """One row for each entity and record: its first observation, or with ``keep='last'`` its last.

    A state that returns after another is the same record and so isn't seen again. ``observed`` always is the first time.
    Ties break by a hash of all other columns. One shuffle, on keys and record, after a partial aggregate.
    """
    rest = [c for c in observations.columns if c not in (*keys, record)]
    order = F.struct(F.col(observed), F.xxhash64(*rest))
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), order).alias("__row")
    found = observations.groupBy(*keys, record).agg(pick, F.min(observed).alias("__seen"))
    return found.select(*((F.col(c) if c in (*keys, record) else F.col("__seen").alias(c) if c == observed else F.col(f"__row.{c}").alias(c)) for c in observations.columns))


def windows(first: DataFrame, keys: list[str], observed: str = "observed_at", tie: str = "record_hash") -> DataFrame:
    """Half-open validity windows: valid_from, valid_to (null for the last) and is_current."""
    w = Window.partitionBy(*keys).orderBy(observed, tie)
    after = F.lead(observed).over(w)
    return first.withColumns({"valid_from": F.col(observed), "valid_to": after, "is_current": F.lead(F.lit(1)).over(w).isNull()})


def versions(observations: DataFrame, keys: list[str], record: str = "record_hash", observed: str = "observed_at", keep: str = "first") -> DataFrame:
    """An observation log folded into versions."""
    return windows(first_observations(observations, keys, record, observed, keep), keys, observed, record)


def current(table: DataFrame) -> DataFrame:
    return table.where("is_current")


def valid_at(at: Column) -> Column:
    return (F.col("valid_from") <= at) & ((F.col("valid_to") > at) | F.col("valid_to").isNull())


def as_of(table: DataFrame, at: Column) -> DataFrame:
    """The rows that held at an instant."""
    return table.where(valid_at(at))


def as_of_join(facts: DataFrame, table: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """``facts`` with ``columns`` of the version valid at each fact's time; null before the first.

    No range join: versions and facts are lined up by key and time in one window and the last version is carried
    forward, so cost is one shuffle and sort by key, whatever the number of versions.
    """
    fact_columns = facts.columns
    left = facts.select(F.struct(*fact_columns).alias("__f"), *keys, F.col(at).alias("__at"), F.lit(1).alias("__o"), F.lit(None).alias("__v"))
    payload = F.struct(*(F.col(c).alias(c) for c in columns))
    right = table.select(F.lit(None).alias("__f"), *keys, F.col("valid_from").alias("__at"), F.lit(0).alias("__o"), payload.alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, 0)
    lined = left.unionByName(right).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where(F.col("__o") == 1)
    return lined.select(*(F.col(f"__f.{c}").alias(c) for c in fact_columns), *(F.col(f"__v.{c}").alias(c) for c in columns))


def summary(table: DataFrame, entity: list[str]) -> DataFrame:
    return table.agg(
        F.count("*").alias("versions"),
        F.count_distinct(*entity).alias("entities"),
        F.coalesce(F.sum(F.when(F.col("is_current"), 1).otherwise(0)), F.lit(0)).cast("long").alias("current_rows"),
    )


def not_one_current(table: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that break the rule of exactly one current row."""
    return table.groupBy(*keys).agg(F.count_if("is_current").alias("current_rows")).where("current_rows <> 1")


def gaps(table: DataFrame, keys: list[str], tie: str = "record_hash") -> DataFrame:
    """Versions whose end isn't the next one's start."""
    w = Window.partitionBy(*keys).orderBy("valid_from", tie)
    following = table.withColumn("next_from", F.lead("valid_from").over(w))
    return following.where(~F.col("valid_to").eqNullSafe(F.col("next_from")))


def multi_version(table: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("versions")).where(F.col("versions") > more_than)


def record_and_text(table: DataFrame, keys: list[str], record: str, text: str) -> DataFrame:
    """Entities with more records than texts: their state changed, their text did not."""
    found = table.groupBy(*keys).agg(F.count_distinct(record).alias("record_versions"), F.count_distinct(text).alias("text_versions"))
    return found.where("record_versions > text_versions")


def fingerprint(table: DataFrame, hash_column: str) -> DataFrame:
    """Order-insensitive fingerprint in bounded memory: rows and two sums of hash prefixes."""
    part = lambda a: F.conv(F.substring(hash_column, a, 8), 16, 10).cast("long")
    return table.agg(F.count("*").alias("n"), F.sum(part(1)).alias("sum_a"), F.sum(part(9)).alias("sum_b"))


#: Hex digits of a leaf's range of hashes; a node above has the ranges that differ in their last two.
LEAF = 6


def exact_fingerprint(table: DataFrame, hash_column: str) -> DataFrame:
    """sha256 over all hashes and how often each occurs, whatever their order, as a tree.

    Hashes are counted first, so one that many rows share is one entry; a leaf is the digest of a fixed range of them, in
    order, and a node that of its up to 256 children. So no group grows with the table beyond a range's hashes, equal
    tables have equal fingerprints however they are spread, and ``fingerprint_ranges`` tells where two tables differ.
    """
    return _above(fingerprint_ranges(table, hash_column), LEAF, 0).select(F.col("digest").alias("fingerprint"))


def fingerprint_ranges(table: DataFrame, hash_column: str, digits: int = LEAF) -> DataFrame:
    """range string, digest: the nodes whose ranges have that many (even) digits."""
    counted = table.groupBy(F.col(hash_column).alias("h")).agg(F.count("*").alias("n"))
    leaves = counted.groupBy(F.substring("h", 1, LEAF).alias("range")).agg(_digest(F.concat("h", F.lit(":"), F.col("n").cast("string"))).alias("digest"))
    return _above(leaves, LEAF, digits)


def _digest(entry: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256)


def _above(nodes: DataFrame, digits: int, wanted: int) -> DataFrame:
    while digits > wanted:
        digits -= 2
        entry = F.concat("range", F.lit(":"), "digest")
        parents = nodes.groupBy(F.substring("range", 1, digits).alias("range")) if digits else nodes.groupBy()
        nodes = parents.agg(_digest(entry).alias("digest"))
    return nodes
