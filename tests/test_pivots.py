"""The pivot index: exact, and it reads a fraction of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import pivots, search
from palimpsest.operators.pivots import PivotIndex


def clustered(n=4000, groups=40, dims=24, noise=0.15, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * noise
    x[100:160] = x[100]  # copies: ties
    return x * rng.uniform(0.5, 3, (n, 1))


def frame(spark, x, extra=()):
    rows = [(i, i % 3, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, kind int, embedding array<double>")


ODD = [(90_001, 1, None), (90_002, 1, [0.0] * 24)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = clustered()
    df = frame(spark, x, ODD).cache()
    index = PivotIndex.build(df, str(tmp_path_factory.mktemp("pivots") / "i"), rows=100)
    yield x, df, index
    df.unpersist()


def scanned(df):
    """Rows that the scans of a plan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()

    def leaves(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(node.executedPlan())
        kids = node.children()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(node.plan())
        return sum((leaves(kids.apply(i)) for i in range(kids.size())), []) or [node]

    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves(plan))


def test_exact_from_few_rows(built):
    x, df, index = built
    rng = np.random.default_rng(3)
    shares = []
    for query in [*x[[0, 100, 159, 7]], x[5] + rng.normal(size=24) * 0.1, rng.normal(size=24)]:
        want = search.ranked(df.where("vec_id < 90000"), list(query), 10).collect()
        found = index.nearest(list(query), 10)
        assert [(r.vec_id, round(r.distance, 9)) for r in found.collect()] == [(r.vec_id, round(r.distance, 9)) for r in want]
        assert set(found.columns) == {"vec_id", "kind", "embedding", "distance"}
        shares.append(scanned(found) / len(x))
    assert max(shares[:5]) <= 0.25 and sum(shares[:5]) / 5 < 0.1, shares  # the last lies between all clusters


def test_files_are_ruled_out_by_their_statistics(built, spark):
    import pyarrow.dataset as ds

    x, _, index = built
    d = pivots._distances(search.unit(x[:1]), index.centres[: index.pivots])[0]
    meets = total = 0
    for fragment in ds.dataset(f"{index.path}/rows").get_fragments():
        for group in fragment.row_groups:
            total += 1
            meets += all(group.statistics[f"__d{i}"]["min"] <= v + 0.3 and group.statistics[f"__d{i}"]["max"] >= v - 0.3 for i, v in enumerate(d))
    assert total >= 40 and meets <= total / 4
    assert "PushedFilters: [IsNotNull(__d0)" in index.nearest(list(x[0]), 10)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_large_k(built):
    x, df, index = built
    want = search.ranked(df.where("vec_id < 90000 and kind = 2"), list(x[9]), 10).collect()
    assert [r.vec_id for r in index.nearest(list(x[9]), 10, F.col("kind") == 2).collect()] == [r.vec_id for r in want]
    assert index.nearest(list(x[9]), 4100).count() == 4000
    assert index.nearest([0.0] * 24, 5).count() == 5


def test_many_queries(built, spark):
    x, df, index = built
    queries = spark.createDataFrame([(i, [float(c) for c in x[i] * 2]) for i in range(0, 4000, 50)] + [(-1, [1.0] * 24)], "query_id int, query_vector array<double>")
    want = search.search_many(df.where("vec_id < 90000"), queries, 7)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect())
    found = index.nearest_many(queries, 7)
    assert key(found) == key(want) and set(found.columns) == set(want.columns)


def test_nothing_and_little(spark, tmp_path):
    empty = PivotIndex.build(frame(spark, [], ODD), f"{tmp_path}/e")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_vector array<double>")
    assert empty.nearest([1.0] * 24, 3).count() == 0 and empty.nearest_many(queries, 3).count() == 0
    one = PivotIndex.build(frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), f"{tmp_path}/o")
    assert [r.vec_id for r in one.nearest([1.0, 0.1], 2).collect()] == [0, 1]
    assert [(r["rank"], r.vec_id) for r in one.nearest_many(queries, 5).orderBy("rank").collect()] == [(1, 2), (2, 0), (3, 1)]


def test_hyperplanes_find_the_neighbours_of_unrelated_queries():
    """The approximate index on queries that are no copies of rows: recall of the ten nearest, and rows read for it."""
    from palimpsest.operators import index

    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 64))  # embeddings vary along few directions
    x, q = (search.unit(rng.normal(size=(n, 6)) @ mix) for n in (6000, 60))
    normals = index.planes(64)
    sides = (x @ normals.T >= 0) @ (1 << np.arange(index.BITS))
    for buckets, least in ((16, 0.9), (32, 0.97)):
        hit, read = [], []
        for v in q:
            probed = index.near_buckets(list(v), normals, buckets)
            hit.append(np.isin(sides[np.argsort(-(x @ v))[:10]], probed).mean())
            read.append(np.isin(sides, probed).mean())
        assert np.mean(hit) >= least and np.mean(read) < 0.5, (np.mean(hit), np.mean(read))
    assert index.near_buckets(list(q[0]), normals, 1) == index.probed(list(q[0]), normals, 0)
    assert sorted(index.near_buckets(list(q[0]), normals, 256)) == list(range(256))
