"""Vectors from a paid model: calls within the bounds of its API, and what they are billed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import token_count
from palimpsest.shipping import ship

#: Texts and tokens of a call at most: a call beyond either is refused as a whole.
MOST_TEXTS, MOST_TOKENS = 128, 100_000

#: Texts to vectors, to items with index and embedding, or to an API's answer (``data`` and ``usage.total_tokens``).
Embedder = Callable[[list[str]], Any]


def answered(found: Any, n: int) -> tuple[list[list[float]], int | None]:
    """``n`` vectors in the order of their texts, and the tokens billed if the answer says so."""
    billed = None
    if isinstance(found, dict):
        billed = (found.get("usage") or {}).get("total_tokens")
        found = found["data"]
    return in_order(found, n), billed


def in_order(found: list, n: int) -> list[list[float]]:
    """``n`` vectors in the order of their texts: as they come, or by the index that an API's items carry."""
    if found and isinstance(found[0], dict):
        found = sorted(found, key=lambda item: item["index"])
        if [item["index"] for item in found] != list(range(len(found))):
            raise ValueError("the embedder's items don't have each index once")
        found = [item["embedding"] for item in found]
    if len(found) != n:
        raise ValueError("the embedder gave another number of vectors than texts")
    return found


def embed(
    docs: DataFrame, embedder: Embedder, text: str = "chunk", out: str = "embedding", tokens: Column | None = None,
    most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS, calls: bool = False,
) -> DataFrame:
    """``docs`` with vectors from an injected ``embedder``, called with at most ``most_texts`` texts of ``most_tokens``
    tokens together; one longer text goes alone.

    Texts go in the order of their partition, and a call is closed only by a text that would pass a bound, wherever
    Arrow's batches end. A null text is an empty one. ``tokens`` counts a text's (blank-separated words by default).
    ``calls`` adds embed_call long (the call, numbered by partition), embed_place int (the text's place in it),
    embed_tokens long (its counted tokens) and embed_billed long (on the first text of a call, what the answer says was
    billed, or else the tokens counted; 0 on others). Write the result before reading it twice: every run of this plan
    pays anew, as does a task that is run again.
    """
    new = ["embed_call", "embed_place", "embed_tokens", "embed_billed"]
    if clash := {out, "__n", *new} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    ship(docs.sparkSession)
    counted = docs.withColumn("__n", F.coalesce((token_count(F.col(text)) if tokens is None else tokens).cast("long"), F.lit(0)))
    at_text, names = docs.columns.index(text), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        texts = total = 0

        def close() -> pa.RecordBatch:
            nonlocal call, texts, total
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            said = [t or "" for t in rows.column(at_text).to_pylist()]
            vectors, billed = answered(embedder(said), len(said))
            sizes = rows.column(len(names))
            columns = [
                *rows.columns[: len(names)], pa.array(vectors, pa.list_(pa.float32())), pa.array([call] * len(said), pa.int64()),
                pa.array(range(len(said)), pa.int32()), sizes, pa.array([total if billed is None else billed] + [0] * (len(said) - 1), pa.int64()),
            ]
            held.clear()
            call, texts, total = call + 1, 0, 0
            return pa.RecordBatch.from_arrays(columns, names=[*names, out, *new])

        for batch in batches:
            start = 0
            for i, n in enumerate(batch.column(len(names)).to_pylist()):
                if texts and (texts >= most_texts or total + n > most_tokens):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    start = i
                    yield close()
                texts, total = texts + 1, total + n
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close()

    fields = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out}` array<float>", "embed_call long, embed_place int, embed_tokens long, embed_billed long"])
    made = counted.mapInArrow(work, fields)
    return made if calls else made.drop(*new)


def usage(made: DataFrame, most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """One row over the calls of ``embed(..., calls=True)``: calls, texts, tokens counted, tokens billed, and how many
    calls have too many texts, have too many tokens (one text alone may), or were closed though the next text of their
    partition would have fitted. Only a row for each call is shuffled."""
    calls = made.groupBy("embed_call").agg(
        F.count("*").alias("texts"), F.sum("embed_tokens").alias("tokens"), F.sum("embed_billed").alias("billed"), F.max(F.when(F.col("embed_place") == 0, F.col("embed_tokens"))).alias("first")
    )
    after = calls.select((F.col("embed_call") - 1).alias("embed_call"), F.col("first").alias("next"))
    early = (F.col("texts") < most_texts) & (F.col("tokens") + F.col("next") <= most_tokens)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.join(after, "embed_call", "left").agg(
        F.count("*").alias("calls"), whole("texts"), whole("tokens"), whole("billed"),
        F.count_if(F.col("texts") > most_texts).alias("over_texts"), F.count_if((F.col("texts") > 1) & (F.col("tokens") > most_tokens)).alias("over_tokens"), F.count_if(early).alias("early"),
    )


def hashing_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """The offline embedder: signed word hashes, scaled to unit length."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dims
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out
