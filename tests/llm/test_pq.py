"""Op 7 against all pairs."""

import numpy as np
import pytest

from palimpsest.llm import pq


def plain(rows):
    ids = [i for i, v in rows]
    x = {}
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v, np.float64)
            a /= np.abs(a).max()
            x[i] = a / np.linalg.norm(a)
    links = {i: {j for j in x if i in x and j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.9} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    for k in range(200, 500):  # copies at many distances, some in chains
        noise = rng.normal(size=64)
        x[k] = x[rng.integers(0, k)] + noise * rng.uniform(0, 0.6)
    x[300:420] = x[7] + rng.normal(size=(120, 64)) * 0.25  # one large group
    x[420:440] = x[8]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def odd():
    ok = [1.0] + [0.0] * 63
    return [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [float("inf")] + [0.0] * 63), (1004, [None] + [1.0] * 63), (1005, ok), (1006, ok), (1007, [2.0] + [0.0] * 63), (1008, [1.0, 0.0]), (1009, [])]


def result(df):
    return {r.vec_id: (r.n_links, r.component, r.kept) for r in pq.near_duplicates(df).collect()}


def test_links_and_components(spark):
    rows = data() + odd()
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v, i % 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, w int")
        assert result(df) == plain(rows)


def test_vectors_of_every_length_and_size(spark):
    rng = np.random.default_rng(8)
    rows = [(n, list(map(float, rng.normal(size=d)))) for n, d in enumerate([5] * 40 + [3] * 30 + [1] * 4)]
    rows += [(100 + n, [2 * c for c in v]) for n, v in rows[::3]]
    rows += [(200, [1e300, 1e300, -1e290]), (201, [3e307, 3e307, 0.0]), (202, [5e-324, 5e-324, 0.0]), (203, [1e-200, 1e-200, 1e-201])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == plain(rows)
    # Lengths that the sample doesn't have.
    assert {r.vec_id: (r.n_links, r.component, r.kept) for r in pq.near_duplicates(df, sample=3).collect()} == plain(rows)


def test_large_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(pq, "PART", 16)
    rows = data()
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == plain(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side
    q = pq.fit(x, 110)
    ox, px, *_ = q.place(x)
    oy, py, *_ = q.place(y)
    found = [a in pb or b in pa for a, b, pa, pb in zip(ox, oy, px, py, strict=True)]
    assert np.mean(found) >= 0.99


def test_look_up_rules_out_no_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq.fit(x, 1)
    own, _, codes, error = q.place(x)
    part = {"id": np.arange(400), "x": x, "codes": codes, "error": error}
    a, b = pq.links_within(q, 0, part, part)
    want = np.argwhere((x @ x.T >= 0.9) & ~np.eye(400, dtype=bool))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(0)
    q, e = rng.integers(0, 30, 60), rng.integers(0, 30, 60)

    def groups(pairs):
        label = list(range(60))
        for a, b in pairs:
            x, y = label[a], label[30 + b]
            label = [x if v == y else v for v in label]
        return [[i == j for j in label] for i in label]

    few = pq._forest(q, e, 30, 30)
    assert len(few) < 60 and groups(zip(q, e, strict=True)) == groups(zip(q[few], e[few], strict=True))


def test_nothing_and_one(spark):
    df = spark.createDataFrame(data()[:1] + [(None, [1.0] * 64)], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, pq.near_duplicates(df).collect()), key=str)
    assert found == sorted([(0, 0, 0, True), (None, 0, None, True)], key=str)
    assert pq.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_vectors_of_low_rank():
    for rank in (6, 8, 12):
        rng = np.random.default_rng(rank)
        x = rng.normal(size=(9000, rank)) @ rng.normal(size=(rank, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = pq.fit(x[:6000], 380)
        own, probes, *_ = q.place(x)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
        sets = [set(p.tolist()) for p in probes]
        assert np.mean([own[j] in sets[i] or own[i] in sets[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.98


def test_query_equals_its_sql_on_vectors_with_links(spark, tmp_path):
    import duckdb
    from palimpsest.llm.queries import OP7_SQL, op7_embeddings

    rows = [(i, v) for i, v in data() + odd() if i < 30 or 250 < i < 330 or i >= 1000]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = duckdb.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({OP7_SQL})").fetchall()
    found = op7_embeddings(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sum(r[1] for r in want) > 500
    assert sorted(map(tuple, found)) == sorted(want)


def grown(n, seed):
    """Unit vectors around many centres, some in chains, with groups of near copies from two to hundreds."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40, 64))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 64)) * rng.uniform(0.2, 0.6, (n, 1))
    x[: n // 20] = x[0] + rng.normal(size=(n // 20, 64)) * 0.1
    x[n // 2 : n // 2 + n // 10] = x[n // 4 : n // 4 + n // 10] + rng.normal(size=(n // 10, 64)) * rng.uniform(0.1, 0.5, (n // 10, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [4000, 12_000])
def test_recall_where_most_lists_are_not_probed(spark, n):
    x = np.float32(grown(n, 9)).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([((x[i : i + 1000] @ x.T) >= 0.9).sum(1) - 1 for i in range(0, len(x), 1000)])
    q = pq.fit(x, round(2 * len(x) ** 0.5))
    assert 3 * q.probes < len(q.coarse)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.zeros(n)
    for r in pq.near_duplicates(df).collect():
        got[r.vec_id] = r.n_links
    assert links.sum() > 1000 and got.sum() >= 0.99 * links.sum() and (got <= links + 1).all()
