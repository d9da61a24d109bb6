"""Identities: hashes, object keys, addresses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shipping import ship

# Paths that change without the content changing, removed before an object is hashed.
VOLATILE = (
    "suggested_topics",
    "related_topics",
    "views",
    "timeline_lookup",
    "message_bus_last_id",
    "details.notification_level",
    "post_stream.posts[].reads",
    "post_stream.posts[].readers_count",
    "post_stream.posts[].score",
    "post_stream.posts[].posts_count",
    "post_stream.posts[].incoming_link_count",
    "post_stream.posts[].trust_level",
)


def digest(*parts: Column | str) -> Column:
    """sha256 of the parts, NUL between them; a null part counts as empty, so places never shift."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts)), 256)


def canonical_time(c: Column) -> Column:
    """A timestamp as microseconds: no session time zone, no formatting."""
    return F.unix_micros(c).cast("string")


def safe(part: Column) -> Column:
    """A key part: runs of other characters than letters, digits, ``.``, ``_`` and ``-`` become one dash; never empty."""
    clean = F.regexp_replace(F.coalesce(part, F.lit("")), r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def object_key(source: Column, space: Column, entity: Column, hash_: Column) -> Column:
    """Where an object lies: source/space=.../entity/first 32 digits of its hash.json."""
    return F.concat(source, F.lit("/space="), safe(space), F.lit("/"), safe(entity), F.lit("/"), F.substring(hash_, 1, 32), F.lit(".json"))


def space_of(path: Column) -> Column:
    return F.regexp_extract(path, "space=([^/]+)/", 1)


def _without(value: Any, path: list[str]) -> Any:
    """``value`` less what ``path`` names; ``name[]`` goes into every item of a list."""
    if not isinstance(value, dict):
        return value
    key, rest = path[0], path[1:]
    listed = key.endswith("[]")
    key = key.removesuffix("[]")
    if key not in value or (listed and not rest):
        return value
    if not rest:
        return {k: v for k, v in value.items() if k != key}
    inner = value[key]
    if listed:
        inner = [_without(v, rest) for v in inner] if isinstance(inner, list) else inner
    else:
        inner = _without(inner, rest)
    return {**value, key: inner}


def pruned(payload: Any, paths: Iterable[str] = ()) -> Any:
    """A copy of a JSON value without the dotted ``paths``; what isn't there is skipped."""
    for path in paths:
        payload = _without(payload, path.split("."))
    return payload


def canonical_hash(payload: Any, paths: Iterable[str] = ()) -> str:
    """sha256 of canonical JSON: sorted keys, no blanks, characters as they are."""
    text = json.dumps(pruned(payload, paths), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def json_hash(docs: DataFrame, payload: str, paths: Iterable[str] = (), out: str = "hash") -> DataFrame:
    """``canonical_hash`` of a column of JSON text of any shape; null where it is no JSON."""
    ship(docs.sparkSession)
    dropped = tuple(paths)

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else canonical_hash(json.loads(text), dropped)
            except ValueError:
                return None

        return texts.map(one)

    return docs.withColumn(out, work(F.col(payload)))


def drop_fields(df: DataFrame, path: str) -> DataFrame:
    """``df`` without a nested field, in JVM expressions: ``a.b`` of a struct or ``a[].b`` of every struct in an array."""
    parts = path.split(".")

    def inside(value: Column, kind: T.DataType, rest: list[str]) -> Column:
        name = rest[0].removesuffix("[]")
        if not isinstance(kind, T.StructType) or name not in kind.names or (rest[0].endswith("[]") and len(rest) == 1):
            return value
        if len(rest) == 1:
            return value.dropFields(name)
        child = kind[name].dataType
        if rest[0].endswith("[]"):
            if not isinstance(child, T.ArrayType):
                return value
            return value.withField(name, F.transform(value[name], lambda x: inside(x, child.elementType, rest[1:])))
        return value.withField(name, inside(value[name], child, rest[1:]))

    top = parts[0].removesuffix("[]")
    if top not in df.columns:
        return df
    if len(parts) == 1:
        return df.drop(top)
    kind = df.schema[top].dataType
    if parts[0].endswith("[]"):
        if not isinstance(kind, T.ArrayType):
            return df
        return df.withColumn(top, F.transform(top, lambda x: inside(x, kind.elementType, parts[1:])))
    return df.withColumn(top, inside(F.col(top), kind, parts[1:]))


def forum_document(protocol: Column, topic: Column) -> Column:
    """Topic ids repeat across forums, so the protocol is part of the identity."""
    return F.concat_ws(":", protocol, topic.cast("string"))


def forum_chunk_index(post: Column, local: Column) -> Column:
    """A topic-wide address of one post's chunk; a bigint, as posts past 21 million overflow an int."""
    return post.cast("long") * 100 + local.cast("long")


def chunk_ref(source: Column, document: Column, index: Column) -> Column:
    return F.concat(source, F.lit(":"), document, F.lit("#"), index.cast("string"))
