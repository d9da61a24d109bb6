"""Text, identities, chunking, curation."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import flags, identity, text
from palimpsest.operators import chunking


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("c")).first()[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("<p>a</p><p>b</p>", "a\nb\n"),  # only blanks are trimmed
        ("<ul><li>x</li><li>y<ul><li>z</li></ul></li></ul>", "x\n y z\n\n".replace("\n ", "\n")),
        ("a &amp;lt; b", "a &lt; b"),
        ("one<br/>two<BR >three", "one\ntwo\nthree"),
        ("<p>a</p>\n\n\n\n<p>b</p>", "a\n\nb\n"),
        ("x &hellip; &mdash;&nbsp;&#39;y&#39;", "x … — 'y'"),
    ],
)
def test_html_to_text(spark, html, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.html_to_text(F.col("h"))).first()[0] == want


@pytest.mark.parametrize("title", ["Welcome to Discourse", "welcome  to the Aave Forum!", "About the Governance category", "FAQ", "readme", "Introduce yourself here", "Terms of Service", "Uncategorized"])
def test_boilerplate(spark, title):
    assert one(spark, text.is_boilerplate(F.col("t")), t=title) is True


@pytest.mark.parametrize("title", ["Welcome Bob to the committee", "Feedback on the fee switch", "About fees", "FAQ about fees", "", "Temp check: meta governance"])
def test_no_boilerplate(spark, title):
    assert one(spark, text.is_boilerplate(F.col("t")), t=title) is False


def test_null_title_is_no_boilerplate(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.is_boilerplate(F.col("t"))).first()[0] is False


@pytest.mark.parametrize(("n", "alone", "want"), [(0, True, False), (19, False, False), (20, False, True), (1, True, True)])
def test_substantive(spark, n, alone, want):
    assert spark.range(1).select(text.is_substantive(F.lit(n), F.lit(alone))).first()[0] is want


def test_sections():
    assert chunking.sections("intro\n# A\nbody a\n## B\n\n# C\nbody c") == [(None, "intro"), ("A", "body a"), ("C", "body c")]
    assert chunking.sections("# only a heading") == [(None, "only a heading")]
    assert chunking.sections("# A\n# B\n") == []
    assert chunking.sections("##\nnext line\nbody") == [("next line", "body")]  # a bare sign takes the next line


def test_windows_overlap():
    words = " ".join(map(str, range(25)))
    found = chunking.token_windows(words, chunking.BlankTokenizer(), 10, 4)
    assert [w.split()[0] for w in found] == ["0", "6", "12", "18"]
    assert found[-1].split()[-1] == "24"
    assert chunking.token_windows("a b", chunking.BlankTokenizer(), 10, 4) == ["a b"]


def test_native_windows_are_the_same(spark):
    words = [" ".join(map(str, range(n))) for n in (0, 1, 10, 11, 16, 17, 40)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    found = [r[0] for r in df.select(text.tokens(F.coalesce("t", F.lit(""))).alias("p")).select(chunking.windows_of("p", 10, 4)).collect()]
    assert found == [chunking.token_windows(w, chunking.BlankTokenizer(), 10, 4) if w else [] for w in words]


def test_native_sections_are_the_same(spark):
    texts = ["intro\n# A\nbody a\n## B\n\n# C\nbody c", "# only a heading", "no heading", "# A\nx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [[tuple(s) for s in r[0]] for r in df.select(chunking.native_sections(F.col("t"))).collect()]
    assert found == [chunking.sections(t) for t in texts]


def test_short_pieces_join_with_their_heading():
    long = " ".join(["w"] * 20)
    found = chunking.chunk(f"# A\n{long}\n# B\nshort\n# C\n{long}", chunking.BlankTokenizer())
    assert [c[2] for c in found] == [f"A\n\n{long}\n\nB\n\nshort", f"C\n\n{long}"]
    assert [c[0] for c in found] == [0, 1]
    assert chunking.chunk("# A\nx", chunking.BlankTokenizer())[0][2] == "A\n\nx"  # the first is never folded
    assert chunking.chunk("  ", chunking.BlankTokenizer()) == [] == chunking.chunk(None, chunking.BlankTokenizer())


def test_titles():
    blank = chunking.BlankTokenizer()
    assert chunking.chunk_titled("Aave", "T", "", blank) == [(0, None, "Aave — T", 3, 0)]
    assert chunking.chunk_titled("Aave", "T", "b c", blank)[0][2:] == ("Aave — T\n\nb c", 5, 2)
    assert chunking.chunk_titled(None, None, "b", blank)[0][2] == "b"
    assert chunking.chunk_titled(None, None, None, blank) == []


def test_prefix_text_on_odd_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.queries import texts
    from palimpsest.queries.registry import ORACLE_SQL

    names = ["src1", "two WORDS", "", None, "ßA", "ǆX", "aΣ", "xİ", "ﬁsh", " a"]
    langs, bodies = ["en", "", None, " de "], ["b", "", None, " ", "\u00a0b \u3000", "\n b\t", "a\u200b "]
    rows = [(n, l, b) for n in names for l in langs for b in bodies]
    rows = [(None if i % 11 == 10 else i - 99, b, l, n) for i, (n, l, b) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["prefix_text"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in texts.prefix_text(spark, str(tmp_path)).collect())


def test_prune_and_hash():
    post = {"post_stream": {"posts": [{"id": 1, "reads": 5}, {"id": 2, "reads": 6}]}, "views": 3, "id": 9}
    again = {"id": 9, "post_stream": {"posts": [{"reads": 7, "id": 1}, {"id": 2}]}, "views": 4}
    assert identity.canonical_hash(post, identity.VOLATILE) == identity.canonical_hash(again, identity.VOLATILE)
    assert identity.canonical_hash(post) != identity.canonical_hash(again)
    assert post["views"] == 3 and identity.pruned(post, ["post_stream.posts[]", "no.where"]) == post
    assert identity.canonical_hash({"a": "é"}) != identity.canonical_hash({"a": "e"})


def test_keys(spark):
    assert [one(spark, identity.safe(F.col("p")), p=p) for p in ("a/b c", "--", "", "x.y_z-1", "//x//")] == ["a-b-c", "unknown", "unknown", "x.y_z-1", "x"]


def test_digest_keeps_places(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    a, b = (r[0] for r in df.select(identity.digest("x", "y", "z")).collect())
    assert a != b


def test_chunk_index_is_wide(spark):
    assert spark.range(1).select(identity.forum_chunk_index(F.lit(30_000_000), F.lit(7))).first()[0] == 3_000_000_007


def test_risk_flags(spark):
    rows = [(10.0, 5.0, [3.0, 2.9], 3), (0.0, None, None, None), (None, 100.0, [60.0, 40.0], 10), (10.0, None, [1.0], 50)]
    df = spark.createDataFrame(rows, "q double, t double, s array<double>, v long")
    found = [r[0] for r in df.select(flags.risk_flags(F.col("q"), F.col("t"), F.col("s"), F.col("v"))).collect()]
    assert found == [["quorum", "close_vote", "low_turnout"], [], [], ["quorum"]]


def test_choice_scores(spark):
    df = spark.createDataFrame([(["a", "b"], [1.0])], "c array<string>, s array<double>")
    assert [tuple(x) for x in df.select(flags.choice_scores(F.col("c"), F.col("s"))).first()[0]] == [(0, "a", 1.0), (1, "b", 0.0)]


def test_piece_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = " ".join(f"token{i}" for i in range(300))
    me = chunking.PieceTokenizer(path)
    df = spark.createDataFrame([(words,)], "body string")
    found = chunking.chunk_documents(df, tokenizer=lambda: chunking.PieceTokenizer(path)).collect()
    assert [r.chunk for r in found] == chunking.token_windows(words, me) and len(found) > 2
    assert [r.tokens for r in found] == [len(me.encode(r.chunk)) for r in found]


def test_folding_is_linear_and_right(spark):
    pieces = [["a"], ["a " * 20, "b", "c", "d " * 12, "e"], [], ["x"] * 3, ["long " * 30] * 3]
    df = spark.createDataFrame([(p,) for p in pieces], "p array<string>")

    def plain(parts):
        out = []
        for p in parts:
            if out and len(p.split()) < 12:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    assert [r[0] for r in df.select(chunking.fold_short("p")).collect()] == [plain(p) for p in pieces]


def test_windows_cut_the_text_once(spark):
    plan = chunking.chunks_native(spark.createDataFrame([("a b",)], "t string"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
