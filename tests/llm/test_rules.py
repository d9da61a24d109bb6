"""Op 8: held-out accuracy, columns against arrays, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import rules


def test_fit_finds_a_conjunction_and_is_sparse():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.8)).astype(float)
    model = rules.fit(x[:2000], y[:2000], list("abcdef"))
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert 0 < len(model.rules) < 60


def test_one_label_or_none_gives_a_constant():
    assert rules.fit(np.zeros((5, 2)), np.ones(5), ["a", "b"]).scores(np.zeros((1, 2)))[0] > 0.5
    assert rules.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).scores(np.zeros((1, 2)))[0] == 0.5


def test_columns_are_the_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = rules.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    values = rules.statistics(F.col("text"))
    rows = rules.score(docs, model).select("score", *(v.cast("double").alias(k) for k, v in values.items())).collect()
    x = np.array([[r[k] for k in values] for r in rows])
    assert np.allclose(model.scores(x), [r.score for r in rows])


def test_held_out_accuracy(spark):
    from palimpsest.llm.queries import op8_quality

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = op8_quality(spark, d)
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    found = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) > 0.95


def test_held_out_is_by_crc(spark):
    import zlib

    df = spark.range(200)
    for r in df.select("id", rules.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)
    assert spark.range(1).select(rules.held_out(F.lit(None).cast("long"))).first()[0] is False


def test_labels_of_held_out_documents_are_not_used(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(rules.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rules.train(docs, labels) == rules.train(docs, turned)
    assert rules.train(docs, labels, sample=20).names == rules.train(docs, labels).names


def test_odd_texts(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = rules.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "\n"), (4, " "), (5, "a " * 60000), (None, "x")], "chars long, text string")
    found = [r.score for r in rules.score(odd, model).collect()]
    assert len(found) == 7 and all(0 <= s <= 1 for s in found)
    assert rules.score(odd.limit(0), model).count() == 0
    empty = rules.train(docs, labels.limit(0))
    assert {r.score for r in rules.score(odd, empty).collect()} == {0.5}
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], labels.schema))
    assert rules.train(docs, nulls) == model


def plain_statistics(text):
    import regex

    t = text or ""
    share = lambda pattern: sum(map(len, regex.findall(pattern, t))) / max(len(t), 1)
    words, lines, split = t.count(" ") + 1, t.count("\n") + 1, regex.split("[ \n]", t)
    return {
        "chars": len(t),
        "word_chars": len(t) / words,
        "line_words": words / lines,
        "symbols": share(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'\"!?()\-]+"),
        "marks": share(r"[.,;:'\"!?()\-]+"),
        "exclaims": share("!+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "distinct_words": len(set(split)) / len(split),
        "repeats": len(regex.findall(r"(?:^|[ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+)[ \t\n\x0b\f\r]\1(?![^ \t\n\x0b\f\r])", t)) / words,
    }


def test_the_query_against_plain_statistics_and_rules(spark, small):
    """Every document's score, by statistics and rules worked out one by one in Python."""
    from math import exp

    from palimpsest.llm.queries import GOOD, op8_quality

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = rules.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op8_quality(spark, small).collect():
        values = plain_statistics(texts[r.doc_id])
        total = model.bias
        for rule, weight in zip(model.rules, model.weights, strict=True):
            if all((values[model.names[k]] > edge) == above for k, above, edge in rule):
                total += weight
        assert abs(r.score - 1 / (1 + exp(-total))) < 1e-9 and r.predicted == (r.score >= GOOD)


def test_clashing_names_are_errors(spark):
    import pytest

    for name in ("score", "__s", "__S"):
        with pytest.raises(ValueError):
            rules.score(spark.createDataFrame([("a", 1)], f"text string, `{name}` int"), rules.Ensemble([]))
