"""Chunks one after another: against whole lists, through a table function, in bounded memory."""

import random
import tracemalloc
from collections import deque

from palimpsest.operators import chunking
from palimpsest.operators.chunking import BARE, HEADING, BlankTokenizer


def plain_sections(text):
    parts, lines = [(None, [])], deque(text.split("\n"))
    while lines:
        line = lines.popleft()
        while BARE.fullmatch(line) and lines:
            line = f"{line}\n{lines.popleft()}"
        if hit := HEADING.fullmatch(line):
            parts.append((hit[2].strip(), []))
        else:
            parts[-1][1].append(line)
    if len(parts) == 1:
        return [(None, text)]
    bodies = [(h, "\n".join(b).strip()) for h, b in parts]
    kept = [(h, b) for h, b in bodies if b]
    return kept if kept or len(parts) > 2 else [(None, text.lstrip("# ").strip())]


def plain_windows(text, target, overlap):
    pieces = text.split()
    if len(pieces) <= target:
        return [text]
    step = max(1, target - overlap)
    last = -(-(len(pieces) - target) // step) * step
    return [c for at in range(0, last + 1, step) if (c := " ".join(pieces[at : at + target]).strip())]


def texts():
    rng = random.Random(5)
    bits = ["# One\n", "#\n", "##  Two \n", "###\n\n", "#x\n", "word ", "a b c d e f g h i j k l m n ", "\n", "#", "#######\n", "# \n# y\n", " # no\n", "\n\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


def test_sections_one_after_another():
    for text in texts():
        assert chunking.sections(text) == plain_sections(text), repr(text)


def test_windows_one_after_another():
    rng = random.Random(6)
    for _ in range(600):
        text = " ".join("x%d" % n for n in range(rng.randint(0, 60)))
        target, overlap = rng.randint(1, 20), rng.randint(-3, 25)
        assert chunking.token_windows(text, BlankTokenizer(), target, overlap) == plain_windows(text, target, overlap), (text, target, overlap)


class Whole(BlankTokenizer):
    """A tokenizer that has no ``each``."""

    each = None

    def __getattribute__(self, name):
        if name == "each":
            raise AttributeError(name)
        return super().__getattribute__(name)


def test_table_function_gives_what_lists_give(spark):
    rows = [(n, "Label" if n % 2 else None, f"t {n}" if n % 3 else None, text if n % 7 else None) for n, text in enumerate(texts()[:300])]
    rows.append((900, "L", "T", "# A\n" + "one two three " * 900))
    docs = spark.createDataFrame(rows, "i int, l string, t string, body string").repartition(3)
    key = lambda df: sorted(map(repr, map(tuple, df.drop("l", "t", "body").collect())))
    assert key(chunking.chunk_rows(docs, "l", "t", "body")) == key(chunking.chunk_documents(docs, "l", "t", "body"))
    assert key(chunking.chunk_rows(docs, tokenizer=Whole)) == key(chunking.chunk_documents(docs))
    assert chunking.chunk_rows(docs.limit(0)).count() == 0


def test_a_document_of_100_megabytes():
    text = "# Head\n" + "lorem ipsum " * (100_000_000 // 12)
    tracemalloc.start()
    n = tokens = 0
    for _, heading, _, size in chunking.each_chunk(text, BlankTokenizer()):
        n, tokens = n + 1, tokens + size
        if n == 5000:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert heading == "Head" and n == 5000 and tokens == 5000 * 401 and peak < 2.2 * len(text)  # the section's own text
