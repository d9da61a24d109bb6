"""Documents to chunks: headings, token windows, folding of short pieces, prefixes.

``chunks_native`` keeps everything in the JVM with the blank-separated tokenizer; ``chunk_documents`` takes any tokenizer
(two callables) through Arrow batches.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import prefixed, token_count, tokens
from palimpsest.shipping import ship

TARGET, OVERLAP, LEAST = 400, 80, 12

# Fixed value: a heading line.
HEADING, BARE = re.compile(r"(#{1,6})\s+(.+)"), re.compile(r"#{1,6}\s*")

CHUNK = "chunk_index int, heading string, chunk string, tokens int, body_tokens int"


class BlankTokenizer:
    """Tokens are what blanks separate; the text between the first and last of a window is kept as one blank each."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def each(self, text: str) -> Iterator[str]:
        return (hit[0] for hit in re.finditer(r"\S+", text))

    def decode(self, pieces: list[str]) -> str:
        return " ".join(pieces)


class PieceTokenizer:
    """Tokens are those of a SentencePiece model at a path; the library is only needed where this is used."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def decode(self, pieces: list[int]) -> str:
        return self.model.decode(pieces)


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, body) parts. Text before the first heading has none; parts without a body go.

    A text that is one heading and nothing else is kept whole, without the leading signs.
    """
    return list(each_section(text))


def each_section(text: str) -> Iterator[tuple[str | None, str]]:
    """``sections`` one after another: only the present one is cut out of the text."""
    heading, begin, headings, kept, resume = None, 0, 0, 0, 0
    for sign in re.finditer(r"^#", text, re.M):
        if sign.start() < resume:
            continue
        end = _line_end(text, sign.start())
        # A bare sign takes the next line that isn't blank.
        while BARE.fullmatch(text, sign.start(), end) and end < len(text):
            end = _line_end(text, end + 1)
        resume = end
        if hit := HEADING.fullmatch(text, sign.start(), end):
            if body := text[begin : sign.start()].strip():
                kept += 1
                yield heading, body
            heading, begin, headings = hit[2].strip(), end, headings + 1
    if not headings:
        yield None, text
    elif body := text[begin:].strip():
        yield heading, body
    elif headings == 1 and not kept:
        yield None, text.lstrip("# ").strip()


def _line_end(text: str, at: int) -> int:
    found = text.find("\n", at)
    return len(text) if found < 0 else found


def token_windows(text: str, tokenizer, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``target`` tokens that overlap; a text of no more tokens stays as it is."""
    return list(each_window(text, tokenizer, target, overlap))


def each_window(text: str, tokenizer, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[str]:
    """``token_windows`` one after another. A tokenizer that has ``each``, an iterator of a text's tokens, is asked for no
    more of them than a window holds."""
    step = max(1, target - overlap)
    pieces = iter(tokenizer.each(text) if hasattr(tokenizer, "each") else tokenizer.encode(text))
    held = list(islice(pieces, target + 1))
    if len(held) <= target:
        yield text
        return
    while True:
        if cut := tokenizer.decode(held[:target]).strip():
            yield cut
        if len(held) <= target:
            return
        skipped = deque(islice(pieces, max(0, step - len(held))), maxlen=0)  # a negative overlap leaves tokens out
        held = [*held[step:], *skipped]
        held += islice(pieces, target + 1 - len(held))


def chunk(text: str | None, tokenizer, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str | None, str, int]]:
    """(index, heading, text, tokens). Pieces of fewer than ``least`` tokens join the one before, heading and all."""
    return list(each_chunk(text, tokenizer, target, overlap, least))


def each_chunk(text: str | None, tokenizer, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple[int, str | None, str, int]]:
    """``chunk`` one after another: a piece waits only for the next that doesn't join it."""
    if not text or not text.strip():
        return
    joined = lambda heading, body: f"{heading}\n\n{body}" if heading else body
    n, first, parts = 0, None, []

    def done() -> tuple[int, str | None, str, int]:
        whole = joined(first, "\n\n".join(parts)).strip()
        return n, first, whole, len(tokenizer.encode(joined(first, "\n\n".join(parts))))

    for heading, body in each_section(text):
        for piece in each_window(body, tokenizer, target, overlap):
            if parts and len(tokenizer.encode(piece)) < least:
                parts.append(joined(heading, piece))
            else:
                if parts:
                    yield done()
                    n += 1
                first, parts = heading, [piece]
    if parts:
        yield done()


def chunk_titled(label: str | None, title: str | None, body: str | None, tokenizer) -> list[tuple[int, str | None, str, int, int]]:
    """Chunks that lead with label and title; body_tokens leaves the prefix out. No body: the prefix alone, with 0."""
    return list(each_titled(label, title, body, tokenizer))


def each_titled(label: str | None, title: str | None, body: str | None, tokenizer) -> Iterator[tuple[int, str | None, str, int, int]]:
    """``chunk_titled`` one after another."""
    head = " — ".join(p for p in ((label or "").strip(), (title or "").strip()) if p)
    body = (body or "").strip()
    if not body:
        yield from ((*c, 0) for c in each_chunk(head, tokenizer))
    elif not head:
        yield from ((*c, c[3]) for c in each_chunk(body, tokenizer))
    else:
        yield from ((i, h, f"{head}\n\n{t}", len(tokenizer.encode(f"{head}\n\n{t}")), n) for i, h, t, n in each_chunk(body, tokenizer))


def chunk_documents(docs: DataFrame, label: str | None = None, title: str | None = None, body: str = "body", tokenizer: Callable[[], object] = BlankTokenizer) -> DataFrame:
    """``docs`` exploded into chunks: chunk_index, heading, chunk, tokens, body_tokens. ``tokenizer`` makes one on the worker."""
    ship(docs.sparkSession)

    @F.pandas_udf(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    def work(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        me = tokenizer()
        names = ("chunk_index", "heading", "chunk", "tokens", "body_tokens")
        for labels, titles, bodies in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in chunk_titled(*row, me)] for row in zip(labels, titles, bodies, strict=True)])

    none = F.lit(None).cast("string")
    made = work(F.col(label) if label else none, F.col(title) if title else none, F.col(body))
    return docs.withColumn("__c", F.explode(made)).select(*docs.columns, "__c.*")


def chunk_rows(docs: DataFrame, label: str | None = None, title: str | None = None, body: str = "body", tokenizer: Callable[[], object] = BlankTokenizer) -> DataFrame:
    """As ``chunk_documents``, by a table function that is joined to each document: its chunks leave the task as they are
    cut, so a document of any length takes its own text and a few chunks, and never an array of all of them."""
    ship(docs.sparkSession)

    class Chunks:
        def __init__(self) -> None:
            self.tokenizer = tokenizer()

        def eval(self, label: str | None, title: str | None, body: str | None) -> Iterator[tuple]:
            yield from each_titled(label, title, body, self.tokenizer)

    made = F.udtf(Chunks, returnType=CHUNK)
    none = F.lit(None).cast("string")
    own = lambda c: F.col(c).outer() if c else none
    return docs.lateralJoin(made(own(label), own(title), own(body)))


def native_sections(text: Column) -> Column:
    """array<struct<heading, body>> by heading lines, in JVM expressions: as ``sections`` for texts whose headings have
    their words on the same line."""
    marked = F.regexp_replace(text, r"(?m)^(#{1,6})[ \t]+(\S.*)$", "\u0001$2\u0002")
    parts = F.split(marked, "\u0001")
    made = F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.struct(F.lit(None).cast("string").alias("heading"), _strip(p).alias("body"))).otherwise(
            F.struct(_strip(F.substring_index(p, "\u0002", 1)).alias("heading"), _strip(F.substring_index(p, "\u0002", -1)).alias("body"))
        ),
    )
    lone = (F.size(parts) == 2) & (F.get(made, F.lit(1)).body == "") & (F.get(made, F.lit(0)).body == "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.get(made, F.lit(1)).heading.alias("body")))
    return F.when(lone, whole).otherwise(F.filter(made, lambda s: s.body != ""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def windows_of(pieces: str, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<string>: windows of the tokens in the column ``pieces``, joined by single blanks. A column and no expression,
    as a window's lambda would work an expression out anew."""
    step = max(1, target - overlap)
    size = F.size(pieces)
    last = F.when(size > target, F.ceil((size - target) / step) * step).otherwise(0).cast("int")
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda at: F.array_join(F.slice(pieces, at + 1, target), " "))
    )


def fold_short(pieces: str, least: int = LEAST) -> Column:
    """array<string>: every piece, of the column ``pieces``, of fewer than ``least`` tokens joins the one before it; the
    first never does. So a piece that doesn't join begins a run, and runs are cut by their beginnings."""
    begins = F.filter(F.transform(pieces, lambda p, i: F.when((i == 0) | (token_count(p) >= least), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(begins, 2, F.size(pieces)), F.array(F.size(pieces)))
    runs = F.arrays_zip(begins.alias("a"), ends.alias("z"))
    return F.when(F.size(pieces) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(runs, lambda r: F.array_join(F.slice(pieces, r["a"] + 1, r["z"] - r["a"]), "\n\n"))
    )


def chunks_native(docs: DataFrame, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` exploded into windows: chunk_index int, chunk string. Linear in the text: it is cut into tokens once."""
    cut = docs.withColumn("__t", tokens(F.coalesce(text, F.lit(""))))
    return cut.select(*docs.columns, F.posexplode(windows_of("__t", target, overlap)).alias("chunk_index", "chunk"))


__all__ = ["BlankTokenizer", "PieceTokenizer", "chunk", "chunk_documents", "chunk_rows", "chunk_titled", "chunks_native", "fold_short", "native_sections", "prefixed", "sections", "token_windows", "windows_of"]
