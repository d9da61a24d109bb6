"""The pipeline, each stage on its own input against a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from palimpsest.llm import decontaminate as dc
from palimpsest.llm import rules
from palimpsest.llm.queries import GOOD, piece_model
from tests.llm.test_decontaminate import plain as plain_edits
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_minhash import plain as plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, small).write.parquet(str(top / str(k)))
        docs = spark.read.parquet(str(top / str(k)))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])
    assert steps[-1].columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_quality(spark, small, steps):
    model = rules.train(steps[0], spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in rules.score(steps[0], model).where(F.col("score") >= GOOD).collect()}
    assert set(texts(steps[1])) == want and texts(steps[1]).items() <= texts(steps[0]).items()


def test_lines(steps):
    before, after = texts(steps[1]), texts(steps[2])
    drop = plain_lines(sorted(before.items()), 50)
    want = {}
    for i, t in before.items():
        rows = t.split("\n")
        kept = [x for n, x in enumerate(rows) if n not in drop.get((i, t), set())]
        if kept:
            want[i] = "\n".join(kept)
    assert after == want
    sizes = {r.doc_id: r.n_chars for r in steps[2].collect()}
    assert all(sizes[i] == len(t) for i, t in after.items() if t != before[i])


def test_near_duplicates(steps):
    before = texts(steps[2])
    groups = plain_groups(sorted(before.items()))
    assert texts(steps[3]) == {i: t for i, t in before.items() if groups[i] == i}


def test_leaks(spark, small, steps):
    items = [dc.normal(r.text or "") for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = texts(steps[3]), texts(steps[4])
    gone = {i for i, t in before.items() if any(p and p in dc.normal(t) for p in items)}
    assert after == {i: t for i, t in before.items() if i not in gone} or all(
        any(p and plain_edits(p, dc.normal(before[i])) <= int(dc.RATE * len(p)) for p in items) for i in set(before) - set(after) - gone
    )
    assert gone and not gone & set(after)


def test_ids(steps):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    before = texts(steps[4])
    assert {r.doc_id: (r.n_tokens, r.ids) for r in steps[5].collect()} == {i: (len(library.encode(t)), library.encode(t)) for i, t in before.items()}


def test_run_is_the_stages_in_order(spark, small, steps):
    assert sorted(map(str, cp.run(spark, small).collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_documents_and_nothing(spark, small):
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (None, "x y z", None, "s", 5), (3, "w " * 300, "en", "s", 600), (3, "w " * 300, "en", "s", 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            found = stage(spark, df, small)
            assert found.count() <= df.count(), name
