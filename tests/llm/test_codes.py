"""Op 13 against plain rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from palimpsest.llm import codes, vantage


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, label, vector), all of one length."""
    kept = [(i, g, [math.floor(c * scale) if abs(c) < 2**60 else int(c) * scale for c in v]) for i, g, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2])
    edges = [k * width // parts for k in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, rows[r][2]))[:entries]
    books = [[list(cut[r][k]) for r in first] for k in range(parts)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            mine = [[] for _ in books[k]]
            for row in cut:
                mine[nearest(k, row[k])[1]].append(row[k])
            books[k] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, books[k])]
    found = [[nearest(k, row[k]) for k in range(parts)] for row in cut]
    mark = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, g, _), e in zip(kept, error):
        by[g] = by.get(g, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by[g], mark) for (i, g, _), f, e in zip(kept, found, error)), key=repr)


def result(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    coded = codes.with_group_errors(codes.encode(df, codes.fit(df)).drop("embedding"))
    return sorted(map(tuple, coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def data(n=120, width=16, size=1.0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width)) * size
    x[40:60] = x[3]  # copies
    x[60:70] = np.round(x[60:70] * 4) / 4
    return [(int(i), int(i) % 3 if i % 11 else None, [float(c) for c in v]) for i, v in enumerate(x)]


def test_codes_against_plain_rounds(spark):
    rows = data() + [(500, 1, None), (501, 1, [float("nan")] * 16), (502, None, [float("-inf")] + [0.0] * 15), (503, 2, [None] + [0.0] * 15), (504, 0, [0.0] * 16), (None, 1, [0.5] * 16)]
    assert result(spark, rows) == plain(rows)


def test_parts_of_unequal_width_and_few_rows(spark):
    rows = [(i, g, v[:13]) for i, g, v in data(30)]
    assert result(spark, rows) == plain(rows)
    few = data(5)
    assert result(spark, few) == plain(few)


def test_sums_that_pass_a_long(spark):
    rows = data(40, 8, 1e3) + [(100 + i, 1, [float((-1) ** (i + k) * 1e21 * (i + 1)) for k in range(8)]) for i in range(6)]
    got, want = result(spark, rows), plain(rows)
    assert [(r[0], r[1], r[4]) for r in got] == [(r[0], r[1], r[4]) for r in want]
    assert [r[2] for r in got] == [min(r[2], codes.MOST) for r in want]


def test_each_length_has_its_own_codebooks(spark):
    short, long = [(i + 1000, g, v[:8]) for i, g, v in data(40)], data(50)
    alone = {r[0]: r for r in plain(short)} | {r[0]: r for r in plain(long)}
    assert all((r[1], r[2], r[4]) == (alone[r[0]][1], alone[r[0]][2], alone[r[0]][4]) for r in result(spark, short + long))
    assert len(result(spark, short + long)) == 90
    assert result(spark, [(1, 1, []), (2, 1, [])]) == plain([(1, 1, []), (2, 1, [])])


def test_nothing_extra_columns_and_clashes(spark):
    df = spark.createDataFrame(data(20), "vec_id long, label int, embedding array<double>")
    assert codes.with_group_errors(codes.encode(df.limit(0), codes.fit(df.limit(0)))).count() == 0
    books = codes.fit(df)
    assert codes.encode(df.selectExpr("*", "'x' AS part", "1 AS v", "2 AS entry"), books).where("part = 'x'").count() == 20
    with pytest.raises(ValueError):
        codes.encode(df.withColumnRenamed("label", "Code"), books)
    one = codes.encode(df, books).first()
    back = np.array(books[16].decode(one.code))
    x = np.floor(np.array(one.embedding) * 4096)
    assert int(((x - back * 4096) ** 2).sum()) == one.error


def test_more_groups_than_are_sent_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(codes, "GROUPS", 2)
    rows = data()
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_by_branch_and_bound(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (16, 2)) if seed % 2 else rng.integers(-2000, 2000, (16, 8))
    if seed > 3:
        entries[5] = entries[2]  # ties go to the lower number
    x = rng.integers(entries.min() - 1, entries.max() + 2, (700, entries.shape[1]))
    kind = object if seed in (3, 6) else np.int64

    def far(i, some):
        return np.sqrt(((entries[some] - entries[i]) ** 2).sum(1).astype(float))

    own, d = vantage.nearest(vantage.grow(np.arange(16), far, 2), entries.astype(kind), x.astype(kind))
    all_d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert own.tolist() == all_d.argmin(1).tolist() and d.tolist() == all_d.min(1).tolist()


def test_digits():
    for n in (0, 5, -5, 1 << 30, -(1 << 30), 3**80, -(3**80)):
        assert sum(v << (codes.DIGIT * k) for k, v in enumerate(codes._digits(n))) == n
        assert all(abs(v) < 1 << 31 for v in codes._digits(n))
