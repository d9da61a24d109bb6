"""Op 12: ids as the tokenizer's, every id in one piece, little padding, best fit against a plain one."""

import random

import numpy as np
import pytest

from palimpsest.llm import packing
from palimpsest.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(word_tokenizer())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def texts():
    rng = random.Random(4)
    out = ["Hello <|endoftext|>x  's 12\n\n ab\tc", "ΑΣ ΣΑΣ İstanbul é ́a  x̀́ H̱. ẖ ", "a\x1cb c d\x85e 日本語 テスト", " 's't", "", "<|startoftext|> <| endoftext|>", "É. é, x., y,. z.\n×. ÷, A.", "x" * 100 + " y"]
    for _ in range(400):
        out.append("".join(rng.choice("abAB '̸̱́ \n\t.,é1<|>") for _ in range(rng.randint(0, 40))))
    return out


def test_ids_of_words(tokenizer, monkeypatch):
    for most, part in ((400_000, 1 << 20), (50, 16)):
        monkeypatch.setattr(packing, "WORDS", most)
        monkeypatch.setattr(packing, "SLICE", part)
        words = packing.Words(word_tokenizer())
        for text in texts():
            assert np.frombuffer(words.of(text), "<u4").tolist() == ids(tokenizer, text)[:-1], text


def test_words_that_come_again_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 100)
    words, asked = packing.Words(word_tokenizer()), []
    encoded = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda some: asked.extend(some) or encoded(some))
    for i in range(30):
        words.of("the same old words " + " ".join(f"new{i}x{j}" for j in range(20)))
        assert len(words.known) <= 100 and len(words.before) <= 100
    assert [asked.count(w) for w in ("the", "same", "old", "words")] == [1] * 4
    assert len(asked) == 4 + 30 * 20


def test_capacities_against_a_plain_search():
    rng = random.Random(0)
    for _ in range(60):
        most = rng.choice([1, 5, 8, 31, 64])
        room, plain = packing.Capacities(most), {}
        for k in range(200):
            if rng.random() < 0.5:
                left = rng.randint(0, most)
                room.put(left, k)
                plain.setdefault(left, []).append(k)
            else:
                need = rng.randint(0, most)
                want = min((n for n in plain if n >= need and plain[n]), default=None)
                got = room.take(need)
                assert got == (None if want is None else (plain[want].pop(), want))


def test_best_fit_decreasing_against_a_plain_one():
    rng = random.Random(3)
    pieces = [(n, 0, 0, np.zeros(rng.choice([1, 7, 20, 63, 64, rng.randint(1, 64)]), "<u4")) for n in range(500)]
    windows = []
    for p in sorted(pieces, key=lambda p: -len(p[3])):
        fit = [w for w in windows if sum(len(x[3]) for x in w) + len(p[3]) <= 64]
        if fit:
            max(fit, key=lambda w: sum(len(x[3]) for x in w)).append(p)
        else:
            windows.append([p])
    got = packing.best_fit(pieces, 64)
    sizes = lambda ws: sorted(sum(len(x[3]) for x in w) for w in ws)
    assert sizes(got) == sizes(windows) and sorted(p[0] for w in got for p in w) == list(range(500))


def held(pieces, tokenizer, docs, window=packing.WINDOW):
    """Checks all laws; the share of padding."""
    by, seq = {}, {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0
    for doc, text in docs:
        want, at = ids(tokenizer, text), 0
        for r in sorted(by.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert np.frombuffer(r.ids, "<u4").tolist() == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    assert not by
    total = padded = 0
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / max(1, total)


def test_whole_table_is_packed(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, word_tokenizer()).collect()
    assert held(rows, tokenizer, [(r.doc_id, r.text) for r in docs.collect()]) < 0.008


def test_odd_rows_small_buffers_and_extra_columns(spark, tokenizer, monkeypatch):
    rows = [(n, t, "x", n) for n, t in enumerate(texts())] + [(9001, None, "x", 1), (9002, "", "x", 1), (9003, "Wort. " * 30_000, "x", 1), (9004, "ab" * 5000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    assert held(packing.pack(df, word_tokenizer()).collect(), tokenizer, [r[:2] for r in rows]) < 0.008
    rng = random.Random(1)
    plan = [(n, np.arange(rng.randint(1, 150), dtype="<u4")) for n in range(2000)]
    monkeypatch.setattr(packing, "TOKENS", 1000)
    got = list(packing.packed(iter(plan), 64))
    assert sorted((p[0], int(i)) for s in got for p in s for i in p[3]) == sorted((n, int(i)) for n, x in plan for i in x)
    assert sum(len(p[3]) for s in got for p in s) / (64 * len(got)) > 0.98
    monkeypatch.setattr(packing, "PIECES", 10)
    assert sum(len(p[3]) for s in packing.packed(iter(plan), 64) for p in s) == sum(len(x) for _, x in plan)


def test_pieces_that_never_fit_together_are_cut():
    plan = [(n, np.zeros(40, "<u4")) for n in range(1000)]
    got = list(packing.packed(iter(plan), 64))
    sizes = [sum(len(p[3]) for p in s) for s in got]
    assert sum(sizes) == 40_000 and all(n == 64 or n & (n - 1) == 0 for n in sizes) and len(sizes) <= 40_000 // 64 + 7


def test_nothing_repeated_ids_and_clashes(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id int, text string")
    rows = packing.pack(df.coalesce(1), word_tokenizer()).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2 and {r.doc_id for r in rows} == {1, None}
    assert packing.pack(df.limit(0), word_tokenizer()).count() == 0
    named = df.select(df.doc_id.cast("string").alias("name"), "text")
    assert packing.pack(named, word_tokenizer(), id="name").where("name = '1'").count() >= 1
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("doc_id", "offset"), word_tokenizer(), id="offset")


def test_sequences_put_pieces_together(spark, tokenizer):
    docs = spark.createDataFrame([(n, " ".join(["one two, three"] * (n * 37 % 300))) for n in range(60)], "doc_id long, text string").repartition(2)
    pieces = packing.pack(docs, word_tokenizer(), window=256).cache()
    made = packing.sequences(pieces).collect()
    assert sum(r.length for r in made) == sum(r.length for r in pieces.collect())
    whole = {(p.id, p.start): np.frombuffer(r.ids, "<u4")[p.offset : p.offset + p.length].tolist() for r in made for p in r.spans}
    for n, text in [(r.doc_id, r.text) for r in docs.collect()]:
        got = [i for (doc, _), part in sorted(whole.items()) if doc == n for i in part]
        assert got == ids(tokenizer, text)
    pieces.unpersist()
