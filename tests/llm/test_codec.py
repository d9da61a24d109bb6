"""Op 1 against the library, and alignment through a compiled character map."""

import random
import struct

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from palimpsest.llm import sentencepiece_codec as sc  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "  a", "a\n b ", "▁x", "a ▁ b", "<s>hi</s>", "<0x0A>", "日本語 テスト 😀 ok", "a\tb\r\n  c\n\n", "x" * 300, "\x00a", "é́ é", "the " * 500]


@pytest.fixture(scope="module")
def both():
    return sentencepiece.SentencePieceProcessor(model_file=PATH), sc.Codec.load(PATH)


def texts():
    rng = random.Random(4)
    letters = "ab cé▁\n\t日😀 .,the "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_ids_and_decoding_are_the_librarys(both):
    library, own = both
    for t in texts():
        ids = library.encode(t)
        assert own.encode(t)[0].tolist() == ids, t
        assert own.decode(ids) == library.decode(ids), t


def test_both_normalisers_agree(both):
    _, own = both
    assert own.plain
    for t in texts():
        for a, b in zip(own.normalise(t), own.normalise_by_prefix(t), strict=True):
            assert (a == b) if isinstance(a, str) else a.tolist() == b.tolist(), t


def test_both_mergers_agree(both):
    _, own = both
    rng = random.Random(9)
    words = ["".join(rng.choice("▁aeinrst日") for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ["a", "日", "▁▁", "\u0378x"]
    quick = [own.cut(w) for w in words]
    ids, sizes, count = own._merge_words(words)
    at = 0
    for w, n in zip(words, count.tolist(), strict=True):
        assert own._ids(w) == (ids[at : at + n].tolist(), sizes[at : at + n].tolist()), w
        at += n
    own.WORD = 0
    try:
        assert [own.cut(w) for w in words] == quick
    finally:
        del own.WORD


def test_spans_tile_the_source(both):
    _, own = both
    for t in texts():
        raw = t.encode()
        ids, begins, ends = own.encode(t)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw, t
        # A piece covers what it stands for.
        for i, a, b in zip(ids.tolist(), begins, ends, strict=True):
            assert raw[a:b] == own.surface[i] or (a == 0 and raw[a:b] == own.surface[i].removeprefix(b" ")) or sc.SPACE in t


def test_many_texts_at_once(both):
    _, own = both
    many = texts()
    ids, begins, ends, where = own.encode_many(many)
    for k, t in enumerate(many):
        one = own.encode(t)
        for got, want in zip((ids, begins, ends), one, strict=True):
            assert got[where[k] : where[k + 1]].tolist() == want.tolist()


def test_user_defined_pieces_of_any_length(both):
    own = sc.Codec.load(PATH)
    long = "<" + "x" * 700 + ">"
    own.pieces.append(long)
    own.scores.append(0.0)
    own.kinds.append(sc.USER_DEFINED)
    own._prepare()
    ids, begins, ends = own.encode(f"a {long} b")
    k = ids.tolist().index(len(own.pieces) - 1)
    assert (begins[k], ends[k]) == (2, 2 + len(long))


def test_decoding_of_broken_bytes(both):
    library, own = both
    byte = own.byte_id
    for ids in ([byte[0xE2], byte[0x82]], [byte[0xFF], 300, byte[0xC3], byte[0xA9]], [1, 300, 2], [0, 300], []):
        assert own.decode(ids) == library.decode(ids)


def units_of(pairs):
    """A double array for one-byte keys: what the trie of a compiled map looks like."""
    base = 256
    units = [0] * 1024
    units[0] = (base ^ 0) << 10
    blob = b""
    for key, value in pairs:
        node = base ^ key[0]
        leaf = 512 + key[0]
        units[node] = ((leaf ^ node) << 10) | 1 << 8 | key[0]
        units[leaf] = 1 << 31 | len(blob)
        blob += value + b"\0"
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + blob


def test_alignment_through_a_character_map(both):
    own = sc.Codec.load(PATH)
    own.charmap = sc.CharMap.parse(units_of([(b"A", b"xyz"), (b"\t", b" "), (b"Z", b"")]))
    own._prepare()
    assert not own.plain
    normal, where = own.normalise("bA\tZc")
    assert normal == "▁bxyz▁c"
    assert where.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 4, 5]
    ids, begins, ends = own.encode("bA\tZc")
    assert own.decode(ids.tolist()) == "bxyz c" and begins[0] == 0 and ends[-1] == 5 and (begins <= ends).all()


def test_squeezing_of_blanks():
    own = sc.Codec.load(PATH)
    own.squeeze = True
    own._prepare()
    normal, where = own.normalise("  a   b  ")
    assert normal == "▁a▁b"
    assert where.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]
    assert own.normalise("   ")[0] == ""


def test_documents(spark, both):
    library, _ = both
    rows = [(1, None, "k"), (2, "", "k"), (3, "hello world", None), (3, "hello world", None), (None, "x " * 5000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sc.encode_documents(df, PATH, slice_bytes=64).collect()
    assert len(found) == 5 and found[0].ids == [] and found[0].decoded == ""
    assert all(r.ids == library.encode(t or "") and r.decoded == (t or "") for r, (_, t, _) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True))
    assert sc.encode_documents(df.limit(0), PATH).count() == 0


def test_query(spark, small):
    import hashlib

    from palimpsest.llm.queries import op1_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r.doc_id: r for r in op1_sentencepiece(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        got = found[r.doc_id]
        assert got.spanned_bytes == len((r.text or "").encode())
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
