"""Ranking: cap, gate, ceiling, fan-out; citations, routes, recall."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import answers, embedding, search


def hits(spark, distances, documents=None):
    rows = [(i, "s", d, x) for i, (x, d) in enumerate(zip(distances, documents or map(str, range(len(distances))), strict=True))]
    return spark.createDataFrame(rows, "vec_id long, source string, document_id string, distance double")


def test_cap(spark):
    found = search.capped(hits(spark, [0.10, 0.11, 0.12, 0.20, 0.30, 0.40], "AAABCD"), 3)
    assert [r.document_id for r in found.orderBy("distance").collect()] == ["A", "B", "C"]


@pytest.mark.parametrize(
    ("distances", "flat"),
    [
        ([0.44 + 0.001 * i for i in range(10)], True),
        ([0.20] + [0.40 + 0.01 * i for i in range(9)], False),
        ([0.345 + 0.0025 * i for i in range(10)], False),
        ([0.42] * 10, False),
        ([0.421] * 10, True),
        ([0.5], False),
        ([], False),
        ([0.44 + 0.001 * i for i in range(10)] + [0.9] * 30, True),
    ],
)
def test_gate(spark, distances, flat):
    assert search.flatness(hits(spark, distances)).first().flat is flat


def vectors(spark):
    rows = [(i, f"p{i % 3}", "proposal" if i % 2 else "forum", str(i // 2), [1.0, float(i), 0.5]) for i in range(30)]
    return spark.createDataFrame(rows, "vec_id long, protocol_name string, source string, document_id string, embedding array<double>")


def test_search_against_plain_ranking(spark):
    import numpy as np

    data = vectors(spark).collect()
    q = np.array([1.0, 3.0, 0.5])
    dist = {r.vec_id: 1 - float(q @ np.array(r.embedding) / np.linalg.norm(q) / np.linalg.norm(r.embedding)) for r in data}
    want = sorted(dist, key=lambda i: (dist[i], i))
    found = [r.vec_id for r in search.ranked(vectors(spark), list(q), 7).collect()]
    assert found == want[:7]
    narrow = [i for i in want if i % 3 == 1 and i % 2]
    assert [r.vec_id for r in search.search(vectors(spark), list(q), 3, None, None, None, model=None, scheme=None, protocol="p1", source="proposal").collect()] == narrow[:3]
    per = search.fan_out(vectors(spark), list(q), "protocol_name", 2, None)
    assert {r.vec_id for r in per.collect()} == {i for k in range(3) for i in [j for j in want if j % 3 == k][:2]}
    queries = spark.createDataFrame([(1, [1.0, 3.0, 0.5]), (2, [1.0, 20.0, 0.5])], "query_id int, query_vector array<double>")
    many = search.search_many(vectors(spark), queries, 4)
    assert [r.vec_id for r in many.where("query_id = 1").orderBy("rank").collect()] == want[:4]


def test_fan_out_caps_documents(spark):
    rows = [(i, "a" if i < 20 else "b", "s", "one" if i < 15 else str(i), [1.0, i / 50]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, protocol_name string, source string, document_id string, embedding array<double>")
    found = search.fan_out(df, [1.0, 0.0], "protocol_name", 3).orderBy("protocol_name", "distance").collect()
    # Twelve rows are fetched for three, all of one document: the others of the group are never looked at.
    assert [(r.protocol_name, r.vec_id) for r in found] == [("a", 0), ("b", 20), ("b", 21), ("b", 22)]
    assert [r.vec_id for r in search.fan_out(df, [1.0, 0.0], "protocol_name", 3, per_document=2).where("protocol_name = 'a'").orderBy("distance").collect()] == [0, 1]


def test_a_search_names_its_model_and_scheme(spark):
    with pytest.raises(TypeError):
        search.search(vectors(spark), [1.0, 0.0, 0.5])
    two = vectors(spark).withColumns({"embedding_model": F.when(F.col("vec_id") < 15, "a").otherwise("b"), "chunk_scheme": F.lit("v2")})
    found = search.search(two, [1.0, 0.0, 0.5], 30, None, None, None, model="b", scheme="v2")
    assert {r.vec_id for r in found.collect()} == set(range(15, 30))
    assert search.search(two, [1.0, 0.0, 0.5], 30, None, None, None, model="b", scheme="v1").count() == 0


def test_a_search_scans_once(spark, tmp_path):
    vectors(spark).write.parquet(f"{tmp_path}/v")
    plan = search.search(spark.read.parquet(f"{tmp_path}/v"), [1.0, 0.0, 0.5], model=None, scheme=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_no_join_for_a_single_query(spark):
    plan = search.ranked(vectors(spark), [1.0, 2.0, 3.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Join" not in plan


def test_ceiling_comes_after_the_cap(spark):
    q = [1.0, 0.0, 0.5]
    found = search.search(vectors(spark), q, 5, max_distance=0.2, min_gap=None, model=None, scheme=None)
    assert all(r.distance <= 0.2 for r in found.collect())


def test_a_flat_profile_gives_nothing(spark):
    same = spark.createDataFrame([(i, "s", str(i), [0.0, 1.0]) for i in range(12)], "vec_id long, source string, document_id string, embedding array<double>")
    low = search.ranked(same, [1.0, 0.3], 12)
    assert search.flatness(low).first().flat is True
    assert search.search(same, [1.0, 0.3], 5, max_distance=None, model=None, scheme=None).count() == 0
    assert search.search(same, [1.0, 0.3], 5, max_distance=None, min_gap=None, model=None, scheme=None).count() == 5


def test_narrowing_lets_other_sources_pass(spark):
    rows = vectors(spark)
    ids = spark.createDataFrame([("0",)], "id string")
    assert {r.vec_id for r in search.narrowed(rows, ids).collect()} == {r.vec_id for r in rows.collect() if r.source == "forum" or r.document_id == "0"}


def test_citations(spark):
    said = spark.createDataFrame([("a [c1] b [c0] c [c1] d [c9] [x]",)], "answer string")
    known = spark.createDataFrame([("c0", "forum", "p:7", 300, 0.12345), ("c1", "proposal", "0x", 0, 0.5)], "marker string, source string, document_id string, chunk_index long, distance double")
    found = [tuple(r) for r in answers.resolve_citations(said, known).orderBy("place").collect()]
    assert found == [(0, "c1", "proposal:0x#0", 0.5, None), (1, "c0", "forum:p:7#300", 0.1235, None), (2, "c9", None, None, "[c9] does not match any retrieved passage")]


def test_routes_on_driver_and_in_frames_agree(spark):
    raws = [
        {"route": "SQL", "scope": "all", "protocol": "Aave", "source": "forum", "since": "2024-01-01", "reason": "x" * 200},
        {"route": "search", "scope": "both", "protocol": "aave", "source": "web", "since": "last year", "reason": ""},
        {"route": " sql ", "scope": "one", "protocol": " Aave ", "source": None, "since": "2024-01-01x", "reason": None},
        {"route": None, "scope": None, "protocol": None, "source": None, "since": None, "reason": None},
        {"route": "hybrid", "scope": "all", "protocol": "ENS", "source": "proposal", "since": "2024/01/01", "reason": "r"},
    ]
    df = spark.createDataFrame(raws, "route string, scope string, protocol string, source string, since string, reason string")
    framed = [r.asDict() for r in answers.normalise_routes(df, ["aave", "ens"]).collect()]
    single = [answers.normalise_route({k: v for k, v in r.items() if v is not None}, ["aave", "ens"]) for r in raws]
    assert framed == single
    assert [r["scope"] for r in single] == ["all", "one", "one", "all", "one"]
    assert single[2]["protocol"] is None and single[2]["route"] == "sql"


def test_recall(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "q int, d string")
    got = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c"), (2, "c")], "q int, d string")
    scores = answers.recall(want, got, "q", ["d"])
    assert sorted(map(tuple, scores.collect())) == [(1, 2, 1, 0.5), (2, 1, 1, 1.0)]
    total = answers.recall_summary(scores).first()
    assert (round(total.micro, 6), total.macro) == (round(2 / 3, 6), 0.75)
    assert answers.recall_summary(scores.limit(0)).first().micro == 0


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, "lookup"), (2, "theme"), (3, "negative"), (4, "negative"), (5, "lookup")], "q int, kind string")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, d string")
    got = spark.createDataFrame([(1, "a"), (2, "c"), (3, "x")], "q int, d string")
    gated = spark.createDataFrame([(1, 0), (3, 2), (3, None), (4, 1)], "q int, score int")
    scored = answers.score_questions(questions, want, got, gated, "q", ["d"])
    assert sorted(map(tuple, scored.collect())) == [
        (1, "lookup", 2, 1, 0.5, True, 1, 0, False),
        (2, "theme", 1, 1, 1.0, False, 0, 0, True),
        (3, "negative", 0, 0, None, None, 2, 1, False),
        (4, "negative", 0, 0, None, None, 1, 0, True),
        (5, "lookup", 0, 0, 0.0, False, 0, 0, True),
    ]
    total = answers.evaluation(scored).first()
    assert (round(total.micro, 6), total.macro, total.positives, total.survived, total.negatives, total.clean, total.prefilter_clean) == (round(2 / 3, 6), 0.5, 3, 1, 2, 1, 0)
    assert sorted(map(tuple, answers.recall_by_kind(scored).collect())) == [("lookup", 0.25, 2), ("theme", 1.0, 1)]


def test_scopes_and_labels(spark):
    rows = spark.createDataFrame([("one", "one"), ("all", "one"), ("all", None), ("all", "all")], "got_scope string, expected_scope string")
    assert {(r.expected_scope, r.questions, r.accuracy) for r in answers.scope_accuracy(rows).collect()} == {("one", 2, 0.5), ("all", 1, 1.0), (None, 3, 2 / 3)}
    labels = spark.createDataFrame([(1, "x")], "id int, label string")
    joined = answers.resolve_labels(spark.createDataFrame([(1,), (2,), (3,)], "id int"), labels, ["id"], ["label"])
    assert tuple(answers.unresolved(joined).first()) == (3, 2)


def test_vectors_take_the_order_of_their_index():
    items = [{"index": 1, "embedding": [1.0]}, {"index": 0, "embedding": [0.0]}]
    assert embedding.in_order(items, 2) == [[0.0], [1.0]] and embedding.in_order([[3.0]], 1) == [[3.0]]
    for wrong, n in ((items, 3), ([{"index": 2, "embedding": []}], 1), ([[1.0]], 2)):
        with pytest.raises(ValueError):
            embedding.in_order(wrong, n)


def test_keep_relevant_counts_missing_as_zero(spark):
    passages = spark.createDataFrame([("a",), ("b",), ("c",)], "m string")
    scores = spark.createDataFrame([("a", 2), ("b", 1)], "m string, score int")
    assert [r.m for r in answers.keep_relevant(passages, scores, ["m"]).collect()] == ["a"]
    assert answers.keep_relevant(passages.withColumn("x", F.lit(1)), scores, ["m"]).columns == ["m", "x"]


def test_more_queries_than_one_block(spark):
    import numpy as np

    n = search.BLOCK + 300
    q = np.random.default_rng(2).normal(size=(n, 3))
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, query_vector array<double>")
    data = vectors(spark)
    rows = data.collect()
    x = np.array([r.embedding for r in rows])
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    d = 1 - q @ x.T
    want = {(i, r + 1, int(j)) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(30), d[i]))[:2])}
    found = search.search_many(data, queries, 2).collect()
    assert len(found) == 2 * n and {(r.query_id, r.rank, r.vec_id) for r in found} == want


def test_index_recall_and_pruning(spark, tmp_path):
    import numpy as np

    from palimpsest.operators import index

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[750:] = x[:750] + rng.normal(size=(750, 32)) * 0.2
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    normals = index.planes(32)
    index.indexed(df, normals).write.partitionBy("bucket").parquet(f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i")
    found = {r.vec_id: r.bucket for r in stored.collect()}
    sides = (x @ normals.T >= 0) @ (1 << np.arange(8))
    assert all(found[i] == b for i, b in enumerate(sides))
    reached = [sides[i + 750] in index.probed(list(x[i]), normals) for i in range(750)]
    assert np.mean(reached) >= 0.95 and len(index.probed(list(x[0]), normals)) == 37
    hits = index.nearest(stored, list(x[0]), 2, normals)
    assert "PartitionFilters: [bucket" in hits._jdf.queryExecution().executedPlan().toString()
    assert [r.vec_id for r in hits.collect()] == [0, 750]


def test_best_of_holds_few_distances_however_many_queries():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, q = search.unit(rng.standard_normal((8192, 8))), search.unit(rng.standard_normal((2048, 8)))
    ties = np.arange(len(x))
    tracemalloc.start()
    i, j, d = search.best_of(q, x, ties, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # all the distances are 134 MB
    want = 1 - q @ x.T
    assert i.tolist() == [n for n in range(len(q)) for _ in range(5)]
    assert j.reshape(-1, 5).tolist() == np.argsort(want, axis=1)[:, :5].tolist()
    assert np.allclose(d, want[i, j])


def test_fan_out_against_a_window_over_all_rows(spark):
    from palimpsest.functions.vectors import cosine_distance

    rng = np.random.default_rng(5)
    odd = {3: None, 8: [0.0, 0.0, 0.0], 13: [1.0, 2.0], 21: [1.0, None, 2.0], 34: [float("nan"), 1.0, 1.0]}
    rows = [(i, None if i % 7 == 0 else i % 3, f"t{i % 50:02}", odd.get(i, [float(x) for x in rng.integers(-2, 3, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g int, t string, embedding array<float>").withColumn("tie", F.concat("t", F.col("id").cast("string")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for k in (1, 5, 200):
            hits = search.fan_out(df, [1.0, 2.0, -1.0], "g", k, None, tie="tie")
            assert "zip_with" not in hits._jdf.queryExecution().executedPlan().toString()
            got = {r.id: r.distance for r in hits.collect()}
            near = df.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0))), 9))
            at = F.row_number().over(Window.partitionBy("g").orderBy("distance", "tie"))
            want = {r.id: r.distance for r in near.withColumn("n", at).where(F.col("n") <= k).collect()}
            none = lambda d: {i for i, x in d.items() if x is None}
            assert none(got) == none(want) and len(got) == len(want)
            key = lambda d: sorted(round(x, 6) for x in d.values() if x is not None and x == x)
            assert key(got) == key(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
