"""Tokens as models count them: byte-level pair merges over a file of ranks.

A text is first cut by a pattern; each piece's bytes are then merged, the pair whose union has the lowest rank first.
Pieces repeat, so what was merged is remembered, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from palimpsest.shipping import ship

# Fixed value: the pattern that published byte-level vocabularies of 50,000 pieces are made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that are remembered, how long they are at most, and from how many bytes on merges go through a heap.
KNOWN, PIECE, LONG = 200_000, 64, 48
#: Bytes of ids that a task holds before it gives them on, besides one text's.
HELD = 1 << 22


def read_ranks(lines: Iterator[str] | list[str]) -> dict[bytes, int]:
    """Ranks from lines of a piece in base 64 and its rank."""
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


class BytePairTokenizer:
    """encode and decode, as chunking takes them. A piece's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def packed(self, text: str) -> bytes:
        """The ids, 32 bits each, little-endian."""
        pieces, known = self.cut(text), self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(pieces)
        made = {piece: np.array(self._merged(piece.encode()), "<i4").tobytes() for piece in new}
        short = {piece: ids for piece, ids in made.items() if len(piece) <= PIECE}
        if len(known) + len(short) <= KNOWN:
            known.update(short)
            if len(short) == len(made):
                return b"".join(map(known.__getitem__, pieces))
        return b"".join([made[piece] if piece in made else known[piece] for piece in pieces])

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no whole character become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _merged(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return self._by_heap(raw) if len(raw) >= LONG else self._by_search(raw)

    def _by_search(self, raw: bytes) -> tuple[int, ...]:
        """Short pieces: look for the lowest pair each time."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2]) for i in range(len(raw) - 1)]
        while any(p is not None for p in pairs):
            at = min((p, i) for i, p in enumerate(pairs) if p is not None)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        return tuple(ranks[p] for p in parts)

    def _by_heap(self, raw: bytes) -> tuple[int, ...]:
        """Long pieces: pairs wait in a heap, and those that a merge has changed are passed over."""
        ranks, n = self.ranks, len(raw)
        end, before, there = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            j = end[i]
            if not there[i] or j >= n or end[j] != z:
                continue
            there[j], end[i] = False, z
            if z < n:
                before[z] = i
                if (r := ranks.get(raw[i : end[z]])) is not None:
                    heapq.heappush(heap, (r, i, end[z]))
            b = before[i]
            if b >= 0 and (r := ranks.get(raw[b:z])) is not None:
                heapq.heappush(heap, (r, b, z))
        return tuple(ranks[raw[i : end[i]]] for i in range(n) if there[i])


#: What this Python worker has made, so that its next task starts with what the last has learnt.
_MADE: dict[int, BytePairTokenizer] = {}


def byte_pairs(spark: SparkSession, path: str, pattern: str = PATTERN) -> Callable[[], BytePairTokenizer]:
    """Makes tokenizers in tasks, for ``chunk_documents`` and ``encoded``, from a file of ranks that the driver reads;
    executors needn't see the path."""
    ship(spark)
    with open(path, encoding="ascii") as f:
        held = spark.sparkContext.broadcast(read_ranks(f))
    key = hash((path, pattern, held.id if hasattr(held, "id") else id(held)))

    def make() -> BytePairTokenizer:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = BytePairTokenizer(held.value, pattern)
        return _MADE[key]

    return make


def encoded(docs: DataFrame, tokenizer: Callable[[], BytePairTokenizer], text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text, array<int>; a null text has none. A task holds packed ids of some HELD
    bytes, however many rows an Arrow batch has."""
    ship(docs.sparkSession)
    if out in docs.columns:
        raise ValueError(f"column {out} is taken")
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = tokenizer()
        for whole in batches:
            texts, start, held, size = whole.column(at), 0, [], 0
            for i in range(whole.num_rows):
                held.append(me.packed(texts[i].as_py() or ""))
                size += len(held[-1])
                if size >= HELD or len(held) >= 512 or i + 1 == whole.num_rows:
                    ends = np.cumsum([0, *map(len, held)]) // 4
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(held), "<i4")))
                    batch = whole.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])
                    start, held, size = i + 1, [], 0

    return docs.mapInArrow(work, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out}` array<int>"]))


def texts_of(found: DataFrame, tokenizer: Callable[[], BytePairTokenizer], id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The bytes that ids stand for, as id and ``raw``, a row's ids at a time: a batch of many long texts never becomes
    a list of all its numbers."""
    ship(found.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = tokenizer()
        for batch in batches:
            names, rows, start, held, size = batch.column(0), batch.column(1), 0, [], 0
            for i in range(batch.num_rows):
                own = rows[i].values
                held.append(None if own is None else me.bytes_of(own.to_numpy(zero_copy_only=False).tolist()))
                size += len(held[-1] or b"")
                if size >= HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([names.slice(start, len(held)), pa.array(held, pa.binary())], names=[id, "raw"])
                    start, held, size = i + 1, [], 0

    return found.select(id, ids).mapInArrow(work, f"`{id}` {dict(found.dtypes)[id]}, raw binary")
