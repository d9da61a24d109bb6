"""Distinct counts by day as sketches: small, kept by group and day, united for any span of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logarithm of a sketch's buckets: at 12 an estimate is off by about 1.6 % of itself.
BUCKETS = 12


def daily_sketches(df: DataFrame, by: list[str], time: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """by.., day, rows long and sketch binary of the different values of each group and day. Nulls aren't counted."""
    made = df.groupBy(*by, F.to_date(time).alias("day"))
    return made.agg(F.count("*").alias("rows"), F.hll_sketch_agg(F.col(value).cast("string"), F.lit(buckets)).alias("sketch"))


def united(sketches: DataFrame, by: list[str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """by.., rows long and distinct long, estimated, over the days from ``since`` up to but without ``until``. Reads the
    days' sketches only, however many rows they stand for."""
    if since is not None:
        sketches = sketches.where(F.col("day") >= since)
    if until is not None:
        sketches = sketches.where(F.col("day") < until)
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
