"""Op 4: signatures estimate Jaccard similarity, components against brute force, edge cases."""

import random
from collections import Counter

import numpy as np

from palimpsest.llm import minhash as mh


def words_of(text):
    w = "".join(c if c.isascii() and (c.isalnum() or c == "_") or ord(c) > 127 else " " for c in text.lower()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_shingles():
    texts = ["a b c d e f", "A, b! C d E f", "x y", "", "x  y", "a b c d e f a b c d e f"]
    own, gram, count = mh.shingles(texts)
    sets = [set(gram[own == i].tolist()) for i in range(6)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] == sets[4] and len(sets[2]) == 1 and not sets[3]
    assert [len(s) for s in sets] == [len(words_of(t)) for t in texts]
    assert count[own == 5].max() == 2


def test_weighted_estimate():
    doc = np.repeat([0, 1], 30)
    element = mh.mix(np.concatenate([np.arange(30), np.arange(10, 40)]).astype(np.uint64))
    rng = np.random.default_rng(2)
    weight = rng.uniform(0.2, 9, 60)
    sig = mh.signatures(doc, element, weight, 2, 4096)
    a, b = np.zeros(40), np.zeros(40)
    a[:30], b[10:] = weight[:30], weight[30:]
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5


def test_few_and_many_elements():
    for n in (1, 3, 5000):
        sig = mh.signatures(np.zeros(n, np.int64), mh.mix(np.arange(n, dtype=np.uint64)), np.ones(n), 1)
        assert sig.shape == (1, mh.K) and (sig != 0).all()


def plain(docs):
    sets = [words_of(t or "") for _, t, *_ in docs]
    label = list(range(len(docs)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (a & b).total() >= 0.8 * (a | b).total() - 1e-9:
                x, y = sorted((top(i), top(j)), key=lambda k: docs[k][0])
                label[y] = x
    return {docs[i][0]: docs[top(i)][0] for i in range(len(docs))}


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((n, " ".join(copy)))
            n += 1
    for _ in range(6):  # repeated passages, of which copies have more or fewer
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 20))]
        for k in rng.sample(range(5, 25), 4):
            docs.append((n, " ".join(base * k)))
            n += 1
    docs += [(n + i, t) for i, t in enumerate([None, None, "", "  .. ", "few words", "Few  words!", "other words"])]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, id long")
    found = {r.doc_id: (r.component, r.kept) for r in mh.near_duplicates(df).collect()}
    want = plain(sorted(docs))
    assert found == {d: (c, c == d) for d, c in want.items()}
    assert len(set(want.values())) < len(docs) - 12


def test_repeated_rows_null_ids_and_nothing(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text), (7, "x")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component, r.kept) for r in mh.near_duplicates(df).collect()), key=lambda r: (r[0] is None, r))
    assert found == [(5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False), (None, None, True)]
    assert mh.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mh, "SMALL", 2)
    monkeypatch.setattr(mh, "PART", 3)
    rng = random.Random(5)
    docs = []
    for _ in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(500)}"
            docs.append((len(docs), " ".join(copy)))
    found = {r.doc_id: r.component for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == plain(docs)


def test_ids_with_several_texts_and_very_long_texts(spark):
    one, two = "a b c d e f g h i j k", "q r s t u v w x y z"
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    docs = [(5, one), (5, two), (3, two), (8, one), (9, long), (4, long + " end"), (6, "z " * 9000), (7, "z " * 9000 + "y")]
    found = sorted(tuple(r) for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert found == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 5, True), (6, 6, True), (7, 6, False), (8, 5, False), (9, 4, False)]


def test_recall_of_bands_and_sketches_at_the_threshold():
    """Pairs at a weighted similarity of just 0.8, with counts: how many share a bucket and pass the filter."""
    rng = np.random.default_rng(4)
    n, found = 400, 0
    for k in range(n):
        weight = rng.integers(1, 4, 150)
        other = weight.copy()
        other[weight.cumsum() > 0.9 * weight.sum()] = 0
        extra = rng.integers(1, 4, 12)
        total, both = weight.sum(), other.sum()
        extra = extra[: max(1, int(np.searchsorted(extra.cumsum(), both / 0.8 - total)))]
        names = mh.mix((np.arange(170) + 1000 * k).astype(np.uint64))
        doc = np.repeat([0, 1], [150, (other > 0).sum() + len(extra)])
        element = np.concatenate([names[:150], names[:150][other > 0], names[150 : 150 + len(extra)]])
        sig = mh.signatures(doc, element, np.concatenate([weight, other[other > 0], extra]), 2)
        bands = (sig[0] == sig[1])[: mh.BANDS * mh.ROWS].reshape(mh.BANDS, mh.ROWS).all(axis=1).any()
        found += bands and ((sig[0] & 3) == (sig[1] & 3)).sum() >= mh.AGREE
    assert found >= 0.99 * n


def test_sketch_filter_loses_less_than_the_bands():
    from math import comb

    agree = mh.SIMILAR + (1 - mh.SIMILAR) / 4
    lost = sum(comb(mh.K, k) * agree**k * (1 - agree) ** (mh.K - k) for k in range(mh.AGREE))
    assert lost < (1 - mh.SIMILAR**mh.ROWS) ** mh.BANDS
