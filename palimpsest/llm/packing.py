"""Packing: documents as token ids in sequences of a fixed length, by best fit decreasing.

A document longer than a window is first cut into full windows. What is left of all documents goes, longest first, to
the tightest open window that still holds it; a segment tree over remaining capacities finds that window. Each task packs
its own partition in one pass, a bounded buffer at a time, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship

WINDOW = 4096
#: The id that ends a document.
END = 2
#: Tokens and pieces that a task packs at once.
TOKENS, PIECES = 1 << 21, 1 << 16
#: A window with at most this share left open is done; emptier ones wait for more pieces, or give theirs to others.
OPEN = 1 / 128
#: Characters that are split into words at once; words that are remembered, and how long they are at most.
SLICE, WORDS, WORD = 1 << 20, 400_000, 48


#: A comma or full stop that stands alone between a letter (of ASCII or Latin-1, in UTF-8) and a blank.
POINT = re.compile(rb"([.,])(?=[ \n])(?:(?<=[a-zA-Z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: The first bytes of combining marks. A normal form may join them to a small letter only, so such text keeps its case.
MARKS = (b"\xcc", b"\xcd")


class Words:
    """Ids of whole texts by a tokenizer that drops white space.

    Such a tokenizer works on each word between blanks by itself (no normal form joins characters across a blank), so
    the ids of words are remembered and only new ones go to the library. Where there are too many, those that have not
    come again for the last WORDS are forgotten, and the others stay. A text is taken in slices that end at a blank.
    Where the tokenizer's file says so, ASCII is remembered in lower case, and a comma or full stop between a
    letter and a blank is a word of its own.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its cores from Spark
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.known, self.before = {b"": b""}, {}
        told = json.loads(tokenizer_json)
        parts = [told.get("normalizer") or {}, told.get("pre_tokenizer") or {}]
        normal, before = ([p, *p.get("normalizers", []), *p.get("pretokenizers", [])] for p in parts)
        self.lower = any(p.get("type") == "Lowercase" for p in normal)
        self.apart = any(r"[^\s\p{L}\p{N}]+" in p.get("pattern", {}).get("Regex", "") for p in before[1:2])
        special = {t["content"]: t["id"] for t in told.get("added_tokens", []) if t.get("special") and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word: all at once with a special token between words, or one by one where there is none."""
        if self.mark is None or any(self.mark in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        # The fast call leaves out where tokens lie in the text.
        (said,) = self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)
        ids = np.array([self.mark_id, *said.ids], "<u4")
        held = ids.tobytes()
        edges = [*(4 * np.flatnonzero(ids == self.mark_id)).tolist(), len(held)]
        return [held[i + 4 : j] for i, j in zip(edges, edges[1:], strict=False)]

    def of(self, text: str) -> bytes:
        """The ids, 32 bits each, little-endian."""
        parts, at, raw = [], 0, text.encode()
        while at < len(raw):
            end = len(raw)
            if end - at > SLICE:
                end = max(raw.rfind(b" ", at + 1, at + SLICE), raw.rfind(b"\n", at + 1, at + SLICE))
                if end < 0:
                    after = [p for p in (raw.find(b" ", at + SLICE), raw.find(b"\n", at + SLICE)) if p >= 0]
                    end = min(after, default=len(raw))
            part = raw[at:end]
            if self.apart:
                part = POINT.sub(rb" \1", part)
            if self.lower and not any(lead in part for lead in MARKS):
                part = part.lower()
            words = part.replace(b"\n", b" ").split(b" ")
            new = set(words).difference(self.known)
            if len(self.known) + len(new) > WORDS:
                self.known, self.before, new = {b"": b""}, self.known, {*words} - {b""}
            if again := [w for w in new if w in self.before]:
                self.known.update((w, self.before[w]) for w in again)
                new.difference_update(again)
            short = [w for w in new if len(w) <= WORD]
            for k in range(0, len(short), 4096):
                some = short[k : k + 4096]
                self.known.update(zip(some, self._encoded([w.decode() for w in some]), strict=True))
            known = self.known
            if len(short) < len(new):
                parts += [known[w] if w in known else self._encoded([w.decode()])[0] for w in words]
            else:
                parts += map(known.__getitem__, words)
            parts, at = [b"".join(parts)], end
        return b"".join(parts)


#: What this Python worker has learnt stays for its next tasks: the last tokenizer's words.
_LAST: dict[str, Words] = {}


def words_of(tokenizer_json: str) -> Words:
    if tokenizer_json not in _LAST:
        _LAST.clear()
        _LAST[tokenizer_json] = Words(tokenizer_json)
    return _LAST[tokenizer_json]


class Capacities:
    """Open windows by how much they still hold, under a segment tree that tells which capacities there are."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        node = self.size + left
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window that holds ``need``, with what it has left; it is taken out."""
        node = self.size + need
        while not self.any[node]:
            while node & 1:  # a right child: what follows lies right of its parent
                node >>= 1
            if not node:
                return None
            node += 1
            if not node & (node - 1):  # past the last leaf of the level
                return None
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        left = node - self.size
        window = self.windows[left].pop()
        while node and not self.windows[left]:
            self.any[node] = 0
            node >>= 1
            if node and (self.any[2 * node] or self.any[2 * node + 1]):
                break
        return window, left


#: doc (its number in the task's buffer of names), start, ids
Piece = tuple[object, int, int, np.ndarray]


def best_fit(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Windows of pieces, each of at most ``window`` ids: longest first, each into the tightest window that holds it;
    pieces of one length in the order given."""
    found: list[list[Piece]] = []
    room = Capacities(window)
    for piece in sorted(pieces, key=lambda p: -len(p[3])):
        got = room.take(len(piece[3]))
        if got is None:
            got = len(found), window
            found.append([])
        found[got[0]].append(piece)
        if got[1] > len(piece[3]):
            room.put(got[1] - len(piece[3]), got[0])
    return found


def _held(pieces: list[Piece]) -> int:
    return sum(len(p[3]) for p in pieces)


def _split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, tokens, ids = piece
    return (doc, start, tokens, ids[:n]), (doc, start + n, tokens, ids[n:])


def filled(windows: list[list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows from open ones, and the pieces of less than one window that are left: the emptiest give their
    pieces, cut where need be, to the fullest."""
    order = sorted(windows, key=_held)
    done, low, high = [], 0, len(order) - 1
    while low < high:
        gap = window - _held(order[high])
        while gap and low < high:
            piece = order[low].pop()
            if len(piece[3]) > gap:
                piece, rest = _split(piece, gap)
                order[low].append(rest)
            order[high].append(piece)
            gap -= len(piece[3])
            if not order[low]:
                low += 1
        if gap:
            break
        done.append(order[high])
        high -= 1
    return done, [p for w in order[low : high + 1] for p in w]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two, which need no padding, from pieces of less than a window."""
    total, found, rest = _held(pieces), [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, now = total & (1 << bit), []
        while need:
            piece = rest.pop()
            if len(piece[3]) > need:
                piece, after = _split(piece, need)
                rest.append(after)
            now.append(piece)
            need -= len(piece[3])
        if now:
            found.append(now)
    return found


def packed(documents: Iterator[tuple[object, np.ndarray]], window: int) -> Iterator[list[Piece]]:
    """Sequences of pieces from (name, ids) of documents.

    When the buffer is full, windows that are nearly full leave and the others' pieces stay in it, unless they are more
    than half of it: then they fill each other. At the end they do so in any case, and what is left becomes sequences
    of powers of two. So at most one share of OPEN of a window is ever padded.
    """
    buffer: list[Piece] = []
    tokens = 0

    def pack(last: bool) -> Iterator[list[Piece]]:
        nonlocal buffer, tokens
        windows = best_fit(buffer, window)
        rest = []
        for one in windows:
            if window - _held(one) <= window * OPEN:
                yield one
            else:
                rest.append(one)
        buffer = [p for w in rest for p in w]
        if last or 2 * _held(buffer) > TOKENS or 2 * len(buffer) > PIECES:
            done, buffer = filled(rest, window)
            yield from done
        if last:
            left = _held(buffer)
            yield from [buffer] if buffer and window - left <= window * OPEN else powers(buffer)
            buffer = []
        tokens = _held(buffer)

    for name, ids in documents:
        whole = len(ids) - len(ids) % window
        for at in range(0, whole, window):
            yield [(name, at, len(ids), ids[at : at + window])]
        if whole < len(ids):
            buffer.append((name, whole, len(ids), ids[whole:].copy()))
            tokens += len(ids) - whole
        if tokens > TOKENS or len(buffer) > PIECES:
            yield from pack(last=False)
    yield from pack(last=True)


def pack(docs: DataFrame, tokenizer_json: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of all documents' ids (each document ends with ``end``), placed in sequences of at most ``window``:
    the id, start long, length long, ids binary (unsigned 32-bit, little-endian), doc_tokens long, sequence_id long,
    offset long.

    A sequence is at least 127/128 full or its length is a power of two, so that little or no padding is needed. A null
    text is an empty one, which still has its end. Documents with the same id, or none, are documents of their own.
    Other columns don't matter; an empty table gives no rows. ``tokenizer_json`` is a tokenizer that drops white space
    (see ``Words``); any word of a text may be as long as the text.

    A task holds TOKENS tokens and one document's. A sequence's number is made of the partition's and its place there:
    where the input's partitions are the same again, as those of files are, a repeated task gives the same rows.
    """
    if id in (names := ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]):
        raise ValueError(f"column {id} is taken")
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tokenizer_json)
    kind = dict(docs.dtypes)[id]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(held.value)
        last = np.array([end], "<u4").tobytes()

        own: list[pa.DataType] = []

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for whole in batches:
                own[:] = [whole.schema.field(0).type]
                for at in range(0, whole.num_rows, 64):
                    some = whole.slice(at, 64)
                    for name, value in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                        yield name, np.frombuffer(words.of(value.as_py() or "") + last, "<u4")

        rows: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 33
        for sequence in packed(documents(), window):
            at = 0
            for name, start, tokens, ids in sequence:
                rows.append((name, start, len(ids), ids.tobytes(), tokens, number, at))
                at += len(ids)
            number, size = number + 1, size + at
            if size > TOKENS // 2 or len(rows) > PIECES // 8:
                yield batch(rows, own[0])
                rows, size = [], 0
        if rows:
            yield batch(rows, own[0])

    def batch(rows: list[tuple], own: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [own, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", *names])

    made = docs.select(F.col(id).alias("name"), F.col(text).alias("text")).mapInArrow(
        write, f"name {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return made.withColumnRenamed("name", id)


def sequences(pieces: DataFrame, id: str = "doc_id") -> DataFrame:
    """A row for each sequence: sequence_id, length long, ids binary, and spans, an array of the documents' ids with
    the start in the document, the offset and the length of each piece."""
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", F.col(id).alias("id"), "start", "ids"))).alias("all"))
    return gathered.select(
        "sequence_id",
        F.aggregate("all", F.lit(0).cast("long"), lambda n, p: n + p.length).alias("length"),
        F.aggregate("all", F.lit(b""), lambda a, p: F.concat(a, p.ids)).alias("ids"),
        F.transform("all", lambda p: F.struct(p.id.alias("id"), p.start.alias("start"), p.offset.alias("offset"), p.length.alias("length"))).alias("spans"),
    )
