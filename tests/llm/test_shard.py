"""Op 6: exact sizes, gapless slots, uniform placing, the same result for the same rows."""

from collections import Counter

import numpy as np

from palimpsest.llm import shard


def test_hypergeometric_draws():
    rng = np.random.default_rng(0)
    drawn = np.array([shard.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert drawn.min() >= 0 and drawn.max() <= 20
    assert abs(drawn.mean() - 6) < 4 * (20 * 0.3 * 0.7 * 80 / 99 / 4000) ** 0.5
    assert abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert shard.hypergeometric(rng, 5, 0, 3) == 3 and shard.hypergeometric(rng, 0, 5, 3) == 0
    big = shard.hypergeometric(rng, 10**12, 39 * 10**12, 10**9)
    assert abs(big - 10**9 / 40) < 1e5


def test_matrix():
    rows = [0, 7, 100, 3, 55]
    m = shard.communication_matrix(rows, 8, 1)
    assert m.sum(axis=1).tolist() == rows
    sizes = m.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1


def test_sizes_slots_and_columns(spark):
    df = spark.range(1003, numPartitions=7).selectExpr("id", "if(id % 3 = 0, null, repeat('x', cast(id % 9 as int))) as text", "id as p")
    found = shard.deal(df, 10, block=20).collect()
    assert sorted((r.id, r.text, r.p) for r in found if r.text) == sorted((r.id, r.text, r.p) for r in df.collect() if r.text)
    sizes = Counter(r.shard for r in found)
    assert set(sizes) == set(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    again = shard.deal(df, 10, block=20).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_placing_is_uniform(spark):
    df = spark.range(4000, numPartitions=5)
    found = np.array([(r.id, r.shard, r.slot) for r in shard.deal(df, 4).collect()])
    quarter = found[:, 0] // 1000
    for q in range(4):
        counts = np.bincount(found[quarter == q, 1], minlength=4)
        assert abs(counts - 250).max() < 70
    assert abs(np.corrcoef(found[:, 0], found[:, 2])[0, 1]) < 0.06


def test_equal_rows_few_rows_and_nothing(spark):
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    sizes = Counter(r.shard for r in shard.deal(same, 8).collect())
    assert sum(sizes.values()) == 50 and max(sizes.values()) - min(sizes.values()) <= 1
    assert shard.deal(same.limit(3), 8).count() == 3
    assert shard.deal(same.limit(0), 8).count() == 0


def test_query(spark, small):
    import zlib

    from palimpsest.llm.queries import op6_sharding

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op6_sharding(spark, small).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(40)}
    assert {r.shard for r in found} == set(range(40)) and all(slots[s] == list(range(len(slots[s]))) for s in slots)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
