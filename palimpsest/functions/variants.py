"""Objects whose keys drift: JSON as variants, read by path, and what their schemas are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """A variant of a JSON text, null where it is none."""
    return F.try_parse_json(payload)


def read_paths(df: DataFrame, variant: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each name: what lies at a path, as a type. Null where the path is missing or what is there
    can't be that type; no schema is needed, and the text is parsed once for all of them."""
    return df.withColumns({name: F.try_variant_get(F.col(variant), path, kind) for name, (path, kind) in wanted.items()})


def schemas(df: DataFrame, variant: str, *by: str) -> DataFrame:
    """The schema that holds all objects of a group (of all, without ``by``): by.., objects long, schema string."""
    return df.groupBy(*by).agg(F.count(variant).alias("objects"), F.schema_of_variant_agg(variant).alias("schema"))


def drifted(before: DataFrame, now: DataFrame, *by: str) -> DataFrame:
    """Groups whose schema is another than before, or that weren't there: by.., schema, was."""
    old = before.select(*by, F.col("schema").alias("was"))
    return now.join(old, list(by), "left").where(~F.col("schema").eqNullSafe(F.col("was"))).select(*by, "schema", "was")
