"""Byte pairs against the published tokenizer."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import bytepairs
from palimpsest.operators import chunking

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    with open(public_tokenizers.path(request.param)) as f:
        ranks = bytepairs.read_ranks(f)
    return bytepairs.BytePairTokenizer(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_odd_texts(both):
    me, want = both
    rng = random.Random(2)
    texts = ["", " ", "a" * 5000, "ab" * 3000 + "!" * 700, "don't  they'll\n\n x\t y ", "日本語 テスト 👩‍👩‍👧 é ́", "<|endoftext|>", "x\x1c\x1fy\x85z　", "0" * 300]
    texts += ["".join(rng.choice("abcdeE '\n\t12.,é日👍\x1c　-") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    for t in texts:
        ids = me.encode(t)
        assert ids == want.encode_ordinary(t), t
        assert me.decode(ids) == t and me.bytes_of(ids) == t.encode()
    assert me.decode(me.encode("日本")[:1]) == want.decode(me.encode("日本")[:1])


def test_search_and_heap_agree(both, monkeypatch):
    me, _ = both
    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choice(b"abcde tion") for _ in range(rng.randint(1, 60)))
        assert me._by_search(raw) == me._by_heap(raw)


def test_ids_of_all_documents(spark, both, request):
    me, want = both
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    make = bytepairs.byte_pairs(spark, public_tokenizers.path(request.node.callspec.params["both"]))
    rows = bytepairs.encoded(docs.select("doc_id", "text"), make).collect()
    assert len(rows) == docs.count()
    assert [r.ids for r in rows] == want.encode_ordinary_batch([r.text or "" for r in rows])


def test_what_is_remembered_is_bounded(both, monkeypatch):
    me, want = both
    monkeypatch.setattr(bytepairs, "KNOWN", 3)
    me.known.clear()
    text = "one two three four five six one two " * 3
    assert me.encode(text) == want.encode_ordinary(text) and len(me.known) <= 3


def test_chunks_by_it(spark, both, request):
    me, _ = both
    make = bytepairs.byte_pairs(spark, public_tokenizers.path(request.node.callspec.params["both"]))
    text = "# One\n" + "Größere words, don't split. " * 200 + "\n# Two\nshort"
    docs = spark.createDataFrame([(1, text), (2, None)], "i int, body string")
    found = chunking.chunk_documents(docs, tokenizer=make).orderBy("chunk_index").collect()
    assert [tuple(r)[2:] for r in found] == [tuple(c) for c in chunking.chunk_titled(None, None, text, me)] and len(found) > 2
    assert all(r.tokens == len(me.encode(r.chunk)) for r in found)


def test_nulls_and_clashes(spark, both, request):
    make = bytepairs.byte_pairs(spark, public_tokenizers.path(request.node.callspec.params["both"]))
    df = spark.createDataFrame([(1, None), (2, "")], "i int, text string")
    assert [r.ids for r in bytepairs.encoded(df, make).collect()] == [[], []]
    assert bytepairs.encoded(df.limit(0), make).count() == 0
    with pytest.raises(ValueError):
        bytepairs.encoded(df.withColumn("ids", F.lit(1)), make)


def test_a_batch_of_many_texts_is_given_on_in_parts(spark, monkeypatch):
    """However many rows come at once, what is held at a time is bounded, and all ids are there and read back."""
    tiny = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    monkeypatch.setattr(bytepairs, "HELD", 64)
    monkeypatch.setattr(bytepairs, "KNOWN", 4)
    made = bytepairs.BytePairTokenizer(tiny)
    texts = ["abc ab " * 9, "", "x" * 200, None, "d\u00e9 e f g h i " + "y" * 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen = []

    class Spy:
        sparkSession = frame.sparkSession  # noqa: N815
        columns, dtypes = frame.columns, frame.dtypes

        def mapInArrow(self, work, kind):  # noqa: N802
            seen.append(list(work(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})]))))

    bytepairs.encoded(Spy(), lambda: made)
    assert len(seen[0]) > 2  # one batch before
    ids = [x for b in seen[0] for x in b.column("ids").to_pylist()]
    assert ids[0][:4] == [257, 32, 256, 32] and [made.bytes_of(x).decode() for x in ids] == [t or "" for t in texts]
    back = bytepairs.texts_of(bytepairs.encoded(frame, lambda: made), lambda: made).collect()
    assert {r.doc_id: bytes(r.raw).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
