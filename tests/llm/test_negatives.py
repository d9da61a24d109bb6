"""Op 11 against all pairs in Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import negatives
from palimpsest.llm.negatives import Asked, Held, best, hard_negatives, integers


def plain(rows, every=5, positives=5, k=3, window=(50, 95)):
    """rows: (id, label, vector)."""
    own = [(i, g, [math.floor(c * 256) for c in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) * 256 < 2**45 for c in v)]
    out = []
    for a, g, q in own:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, h == g) for i, h, v in own if i != a and len(v) == len(q))
        for ps, p in [(-s, i) for s, i, same in scored if same][:positives]:
            fit = [(-s, i) for s, i, same in scored if not same and window[0] * ps <= 100 * -s <= window[1] * ps][:k]
            out += [(a, p, r + 1, i, min(ps, negatives.MOST), min(s, negatives.MOST)) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def result(spark, rows, every=5, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()))


def data(n=400, width=8, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + 0.7
    x[50:120] = x[3] + rng.normal(size=x[50:120].shape) * 0.05  # near copies
    x[120:160] = x[7]  # copies: ties
    return [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]


ODD = [
    (1000, None, [1.0] * 8), (1005, 1, None), (1010, 1, [float("nan")] * 8), (1015, 1, [float("inf")] + [1.0] * 7), (1020, 1, [None] + [1.0] * 7),
    (None, 1, [1.0] * 8), (1025, 1, [0.0] * 8), (1030, 2, [-1.0] * 8), (1035, 3, [2.0, 1.0]), (1036, 3, [1.0, 1.0]), (1037, 2, [1.0, 1.0]), (1040, 1, []), (1041, 1, []), (1042, 2, []),
    (1045, 1, [1e300] * 8),
]


def test_against_all_pairs(spark):
    rows = data() + ODD
    got = result(spark, rows)
    assert got == plain(rows) and len(got) > 300


def test_floats_other_windows_and_counts(spark):
    rows = [(i, g, [float(np.float32(c)) for c in v]) for i, g, v in data(200, 5, 4)]
    assert result(spark, rows, kind="float") == plain(rows)
    assert result(spark, rows, positives=2, negatives=7, window=(-100, 120)) == plain(rows, positives=2, k=7, window=(-100, 120))


def test_repeated_ids_and_rows(spark):
    rows = data(60) + data(60)[:30] + [(10, 2, [0.5] * 8), (10, 2, [0.5] * 8)]
    assert result(spark, rows, every=10) == plain(rows, every=10)


def test_scores_beyond_doubles(spark):
    rows = [(i, g, [c * 2e8 for c in v]) for i, g, v in data(80)]
    got = result(spark, rows)
    assert got == plain(rows) and len(got) > 30


def test_cells_that_are_dealt_on(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "SAMPLE", 64)
    rows = data(300)
    assert result(spark, rows) == plain(rows)


def test_nothing_and_little(spark):
    assert result(spark, []) == [] and result(spark, [(0, 1, [1.0, 2.0])]) == []
    assert result(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.6])]) == plain([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.6])]) != []


def test_ids_and_labels_of_other_types_and_clashing_columns(spark):
    rows = [(f"v{i:03}", "abcd"[g], v, 1, "x") for i, g, v in data(80)]
    df = spark.createDataFrame(rows, "vec_id string, label string, embedding array<double>, cell int, uid string")
    got = sorted((int(r.anchor_id[1:]), int(r.positive_id[1:]), r.rank, int(r.negative_id[1:]), r.positive_score, r.negative_score) for r in hard_negatives(df, F.col("vec_id").endswith("0")).collect())
    assert got == plain(data(80), every=10)


def test_search_leaves_out_most_of_a_clustered_block(monkeypatch):
    """Bounds rule leaves out, and what they rule out holds nothing."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 5
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    x = integers(4 * x / np.linalg.norm(x, axis=1, keepdims=True), 256)
    held = Held(np.arange(4000), rng.integers(0, 2, 4000), x, float((x * x).sum(1).max()))
    q = x[:50]
    looked = []
    real = negatives._dot
    monkeypatch.setattr(negatives, "_dot", lambda a, b: (looked.append(len(a) * len(b)), real(a, b))[1])
    none = np.full(50, np.inf)
    w, s, r = best(held, Asked(q, held.id[:50], held.label[:50], np.arange(50), -none, none), 5, True)
    assert sum(looked) < 0.25 * 50 * 4000
    scores = q @ x.T
    for i in range(50):
        want = sorted((-scores[i, j], j) for j in range(4000) if j != i and held.label[j] == held.label[i])[:5]
        assert [(-a, b) for a, b in zip(s[w == i].tolist(), r[w == i].tolist())] == want
