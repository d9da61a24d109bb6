"""Op 9: parsing, templates, extraction."""

import html as entities
import random
import re
from collections import Counter

from palimpsest.llm import html


def page(n, body, chrome=True):
    top = f"<nav><ul><li><a href=/>Home</a><li><a href=/b>About {n % 2}</a></ul></nav><div class='ad box'>Buy {n}!</div>" if chrome else ""
    return f"<!DOCTYPE html><html><head><title>t{n}</title><script>var a='</p><p>no';</script></head><body>{top}{body}<footer>&copy; x</footer></body></html>"


def test_blocks():
    text = html.extract(page(1, "<article><h1>A &amp; B</h1><p>one<br>two <b>bo</b>ld</p><p>un closed<p>&lt;x&gt; 1 < 2 &amp</article>"), None)
    assert text == "A & B\n\none two bold\n\nun closed\n\n<x> 1 < 2 &"


def test_furniture_inside_the_article():
    body = "<article><header><h1>T</h1></header><p>a</p><aside>no</aside><form><p>no</p></form><div class='comments'><p>no</p></div><figure><figcaption>f</figcaption></figure><p>b</p></article>"
    assert html.extract(page(1, body), None) == "T\n\na\n\nf\n\nb"


def test_broken_pages():
    assert html.extract("", None) == "" == html.extract("<", None).strip("<")
    assert html.extract("<article><p>a<p", None) == "a"
    assert html.extract("<article><p>a<!-- b", None) == "a"
    assert html.extract("<article><p>a<script>x", None) == "a"
    assert html.extract("plain", None) == "plain"
    assert html.extract("<article>" + "<div>" * 300 + "deep", None) == "deep"


def test_host(spark):
    urls = ["http://A.example.com/x", "https://u:p@b.org:80?q", None, "no url", "ftp://c"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html.host(df.u)).collect()] == ["a.example.com", "b.org", "", "", "c"]


def test_template_finds_the_slot_without_article_elements(spark):
    body = "<div id='wrap'><div class='top'>Site name</div><div class='story'><h2>Title {0}</h2><p>Words of page {0}, which differ.</p></div><div class='low'>All rights reserved</div></div>"
    rows = [(n, "http://h.com/" + str(n), page(n, body.format(n))) for n in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.main_text(df).collect():
        assert r.text == f"Title {r.page_id}\n\nWords of page {r.page_id}, which differ."


def test_classes_hold_tokens_of_equal_occurrence(spark):
    rows = [(n, "h", page(n, "<article>" + "<p>x</p>" * (n % 3 + 1) + "</article>")) for n in range(9)]
    made = html.templates(spark.createDataFrame(rows, "id long, host string, html string")).collect()
    assert [r.host for r in made] == ["h"]
    kinds = {t["class"] for t in made[0].template}
    tokens = {t["token"]: t["class"] for t in made[0].template}
    article, footer = html.name("/html/body/article"), html.name("/html/body/footer")
    assert tokens[article] == tokens[footer] and html.name("/html/body/article/p") not in tokens and len(kinds) >= 1


def test_rows_null_and_repeated(spark):
    p = page(1, "<article><p>a</p></article>")
    rows = [(1, None, p), (1, None, p), (2, "u", None), (None, "http://x/", ""), (3, "http://x/", p)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html.F.lit("clash"))
    found = sorted(((r.page_id, r.url, r.text) for r in html.main_text(df).collect()), key=str)
    assert found == sorted([(1, None, "a"), (1, None, "a"), (2, "u", ""), (None, "http://x/", ""), (3, "http://x/", "a")], key=str)
    assert html.main_text(df.limit(0)).count() == 0


def test_all_pages_of_the_table(spark):
    from palimpsest.llm.queries import op9_html

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    found = op9_html(spark, d).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(entities.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert (r.text, r.n_chars) == (want, len(want))


def texts_of(spark, bodies):
    rows = [(n, "http://h.com/" + str(n), page(n, body)) for n, body in enumerate(bodies)]
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_slot_keeps_short_texts_beside_a_long_body(spark):
    body = "<div id=post><h1>Title {0}</h1><div class=body><p>{1}</p></div><div class=last>End of {0}</div></div><div class=low>All rights reserved</div>"
    found = texts_of(spark, [body.format(n, f"word{n} " * 300) for n in range(12)])
    assert found == {n: f"Title {n}\n\n{' '.join([f'word{n}'] * 300)}\n\nEnd of {n}" for n in range(12)}


def test_names_never_drop_the_content():
    for wrap in ("has-sidebar", "layout with-sidebar", "page-header-fixed", "post type-post comments-open", "layout sidebar", "header"):
        assert html.extract(page(1, f"<div class='{wrap}'><h1>T</h1><p>the whole text</p></div>"), None) == "T\n\nthe whole text"
        assert html.extract(page(1, f"<article class='{wrap}'><p>a</p></article>"), None) == "a"
        assert html.extract(page(1, f"<div class='{wrap}'><article><p>a</p></article></div>"), None) == "a"
    assert html.extract(page(1, "<article class='post comments'><p>a</p></article><div class='comments'>no</div>"), None) == "a"
    furniture = "".join(f"<div class='{n}'>no</div>" for n in ("nav-menu", "box ad-banner", "cookie_notice", "navbar", "advertisement"))
    assert html.extract(page(1, furniture + "<div class=story>the whole text, which is longer than what is dropped</div>"), None) == "the whole text, which is longer than what is dropped"
    teaser = "<div class='related'><article><p>no</p></article></div>"
    assert html.extract(page(1, "<article><p>the text</p></article>" + teaser), None) == "the text"


def test_template_decides_inside_and_beside_content_elements(spark):
    notice = "<div class=box1>Write to us about this story</div>"
    found = texts_of(spark, [f"<article><p>first words of {n}</p>{notice}<p>last words of {n}</p></article><article><p>more {n}</p></article>" for n in range(8)])
    assert found == {n: f"first words of {n}\n\nlast words of {n}\n\nmore {n}" for n in range(8)}
    found = texts_of(spark, [f"<div class=story><p>{f'long {n} ' * 20}</p></div><article class=teaser><p>short {n}</p></article>" for n in range(8)])
    assert all(found[n] == f"{' '.join([f'long {n}'] * 20)}\n\nshort {n}" for n in range(8))


def test_copies_of_an_article_are_no_template(spark):
    table = "<table><tr><td>cell one</td><td>cell two</td></tr></table>"
    for copies in (12, 8):
        bodies = [f"<div class=main><article><p>same text</p>{table}<p>to the end</p></article></div>"] * copies
        bodies += [f"<div class=main><article><p>text {n}</p></article></div>" for n in range(12 - copies)]
        found = texts_of(spark, bodies)
        assert [found[n] for n in range(copies)] == ["same text\n\ncell one\n\ncell two\n\nto the end"] * copies
        assert [found[n + copies] for n in range(12 - copies)] == [f"text {n}" for n in range(12 - copies)]


def test_each_layout_of_a_host_has_its_template(spark):
    menus = {"news": "<ul class=top><li>Politics</li><li>Culture</li></ul>", "forum": "<p class=rules>Be kind</p>", "product": "<p class=pay>Pay by card</p>"}
    bodies = [f"<div class=page-{k}>{m}<div class=body><h1>{k} {n}</h1><p>text {n} of {k}</p></div></div>" for k, m in menus.items() for n in range(5)]
    found = texts_of(spark, bodies)
    assert [found[n] for n in range(15)] == [f"{k} {n}\n\ntext {n} of {k}" for k in menus for n in range(5)]


def test_templates_are_the_classes_of_equal_occurrence_vectors(spark):
    rng = random.Random(3)
    rows = []
    for h in range(4):
        for n in range(rng.randint(2, 14)):
            body = "".join(f"<div class={rng.choice('abc')}><p>{rng.choice(['one', 'two', n])}</p><i>x</i></div>" for _ in range(rng.randint(0, 4)))
            rows.append((n, f"h{h}", f"<body><ul><li>{h}</li></ul><div><h1>{n}</h1>{body}</div><b>end</b></body>"))
    made = html.templates(spark.createDataFrame(rows, "id long, host string, html string")).collect()
    assert {r.host: r.pages for r in made} == Counter(r[1] for r in rows)
    for r in made:
        pages = [html.page_tokens(page) for _, where, page in rows if where == r.host]
        vectors, elements = {}, set()
        for k, page in enumerate(pages):
            for token, count, at in page:
                vectors.setdefault(token, {})[k] = count
                if at >= 0:
                    elements.add(token)
        classes = {}
        for token, vector in vectors.items():
            if token and len(vector) >= max(2, 0.02 * len(pages)) and (len(vector) >= 3 or len(vector) >= 0.5 * len(pages)):
                classes.setdefault(tuple(sorted(vector.items())), set()).add(token)
        # A token whose mean place is that of the page itself (0) is none; texts alone make no class.
        want = {frozenset(c) for c in classes.values() if len(c) >= 3 and c & elements}
        got = {}
        for t in r.template or []:
            got.setdefault(t["class"], set()).add(t.token)
        assert {frozenset(c) for c in got.values()} == want


def test_classes_that_cross_do_not_both_belong():
    nodes, texts = html.parse("<a1></a1><b1></b1><a2></a2><b2></b2><a3></a3><b3>text</b3><c1></c1><c2></c2><c3>more</c3>")
    for node in nodes[1:]:
        node.token = html.name(node.path)
    tokens = {n.token: (ord(n.tag[0]), i, {"a": 9, "b": 5, "c": 4}[n.tag[0]]) for i, n in enumerate(nodes) if i}
    tokens[nodes[5].token] = (ord("a"), 5, 9)
    texts.append((5, "in a", True))
    good, _ = html.Template(tokens).valid(nodes, texts)
    assert {n.tag for n in nodes if n.token in good} == {"a1", "a2", "a3", "c1", "c2", "c3"}
    assert html.between([3, 4], [1, 2, 5]) and html.between([6], [1, 2]) and not html.between([1, 3], [2, 4])


def test_names_drop_no_part_of_the_slot(spark):
    parts = ("<section class='related work'><p>prior art</p></section>", "<p class='notice period'>thirty days</p>", "<div id='search'>how we searched</div>")
    for part in parts:
        inner = re.sub("<[^>]*>", "", part)
        assert html.extract(page(1, f"<article><p>a</p>{part}<p>b</p></article>"), None) == f"a\n\n{inner}\n\nb"
        found = texts_of(spark, [f"<div class=story><h1>title {n}</h1><p>text {n}</p>{part if n == 3 else ''}</div>" for n in range(6)])
        assert found == {n: f"title {n}\n\ntext {n}" + (f"\n\n{inner}" if n == 3 else "") for n in range(6)}
    # What stands there on every page and is named so is no part of it.
    found = texts_of(spark, [f"<article><h1>t {n}</h1><p>text {n}</p><div class='related'><a href=/{n}>see {n + 1}</a></div></article>" for n in range(6)])
    assert found == {n: f"t {n}\n\ntext {n}" for n in range(6)}


def test_chrome_inside_the_slot_and_pages_without_content_elements(spark):
    story = "<div class=story><div class=tools><span>Print</span><span>Mail</span></div><h1>t {0}</h1><p>{1}</p><div class=comments><p>me too {0}</p></div></div><div class=low>Rights</div>"
    found = texts_of(spark, [story.format(n, f"text of {n} " * 9) for n in range(7)])
    assert found == {n: f"t {n}\n\n" + (f"text of {n} " * 9).strip() for n in range(7)}


def test_large_templates_and_hot_hosts(spark, monkeypatch):
    body = "<div class=top>Site {1}</div><div class='story'><h2>Title {0}</h2><p>Words of page {0}</p></div><div class='low'>Rights</div>"
    rows = [(n, f"http://h{n % 9 % 7 % 3}.com/{n}", page(n, body.format(n, n % 9 % 7 % 3))) for n in range(60)] + [(60 + n, f"http://lone{n}.com", page(n, f"<p>lone {n}</p>")) for n in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = sorted(map(tuple, html.main_text(df).collect()))
    assert [t for i, _, t in want][:2] == ["Title 0\n\nWords of page 0", "Title 1\n\nWords of page 1"]
    monkeypatch.setattr(html, "HOT", 8)
    assert sorted(map(tuple, html.main_text(df, held=0).collect())) == want
    assert html.main_text(df.limit(0), held=-1).count() == 0


def test_very_long_pages():
    long = "word " * 200_000
    assert html.extract(f"<body><nav>no</nav><article><p>{long}</p></article></body>", None) == long.strip()


def test_what_articles_share_stays(spark):
    release = "<section class=release><p>About us one.</p><p>About us two.</p><p>About us three.</p><p>For {0} only.</p></section>"
    bodies = [f"<article><h1>t {n}</h1><p>text {n}</p>{release.format(n) if n % 5 == 0 else ''}<p>end {n}</p></article>" for n in range(20)]
    found = texts_of(spark, bodies)
    for n in range(20):
        shared = ["About us one.", "About us two.", "About us three.", f"For {n} only."] if n % 5 == 0 else []
        assert found[n] == "\n\n".join([f"t {n}", f"text {n}", *shared, f"end {n}"])


def test_headings_between_own_blocks_stay(spark):
    recipe = "<div class=recipe><h2>Ingredients</h2><ul><li>salt {0}</li></ul><h2>Method</h2><p>stir {0}</p></div>"
    found = texts_of(spark, [f"<article><h1>t {n}</h1>{recipe.format(n) if n < 6 else f'<p>text {n}</p>'}</article>" for n in range(20)])
    assert found == {n: f"t {n}\n\n" + (f"Ingredients\n\nsalt {n}\n\nMethod\n\nstir {n}" if n < 6 else f"text {n}") for n in range(20)}
    found = texts_of(spark, [f"<div class=story><h1>t {n}</h1><p>text {n}</p><h2>Conclusion</h2><p>so {n}</p><p class=foot>Printed on paper</p></div><div class=low>Rights</div>" for n in range(9)])
    assert found == {n: f"t {n}\n\ntext {n}\n\nConclusion\n\nso {n}" for n in range(9)}


def test_a_form_around_the_page_is_no_furniture(spark):
    inner = "<nav>menu</nav><article><h1>T</h1><p>text</p><form><p>vote</p></form></article><form><p>search</p></form>"
    assert html.extract(page(1, f"<form runat=server>{inner}</form>"), None) == "T\n\ntext"
    assert html.extract(page(1, "<form runat=server><nav>menu</nav><div class=story><h1>T</h1><p>text</p></div></form>"), None) == "T\n\ntext"
    assert html.extract(page(1, "<form runat=server><nav>menu</nav><div class=story><p>text</p></div></form>"), None) == "text"
    found = texts_of(spark, [f"<form runat=server><div class=top>Site</div><div class=story><p>text {n}</p></div><div class=low>Rights</div></form>" for n in range(6)])
    assert found == {n: f"text {n}" for n in range(6)}


def test_names_and_kinds_inside_an_article():
    for part in ("<section id=consent><p>x y</p></section>", "<p class=social>x y</p>", "<span class=share>x y</span>", "<dialog open>x y</dialog>"):
        assert html.extract(page(1, f"<article><p>a</p>{part}<p>b</p></article>"), None) == "a\n\nx y\n\nb", part
    for part in ("<dialog>no</dialog>", "<div class=share>no</div>", "<div id=comments>no</div>", "<nav>no</nav>", "<footer>no</footer>", "<section class=newsletter>no</section>", "<button>no</button>"):
        assert html.extract(page(1, f"<article><p>a</p>{part}<p>b</p></article>"), None) == "a\n\nb", part


def test_comments_under_other_names_and_menus_alone():
    assert html.extract(page(1, "<div class=story><h1>T</h1><p>text</p></div><div class=reader-responses><p>me too, and much more of it than of the text</p></div>"), None) == "T\n\ntext"
    assert html.extract(page(1, "", chrome=False), None) == "" == html.extract("<nav>a</nav><footer>b</footer>", None)
    assert html.extract(page(1, "<article></article><div>beside</div>"), None) == ""


def test_no_size_decides(spark):
    """What stands beside a content element is no article however long; a name drops its element however much it holds."""
    for times in (1, 500):
        beside = f"<div class=x9>{'other ' * times}</div>"
        found = texts_of(spark, [f"<article><p>text {n}</p></article>{beside}<p>{n} {'beside ' * times}</p>" for n in range(6)])
        assert found == {n: f"text {n}" for n in range(6)}
        assert html.extract(page(1, f"<div class='ad box'>{'buy ' * times}</div><div class=story><h1>T</h1></div>"), None) == "T"
        assert html.extract(page(1, f"<p>tagline {'x ' * times}</p><div class='layout sidebar'><h1>T</h1><p>text</p></div>"), None).endswith("T\n\ntext")


#: Pages of four layouts without article elements, and what a reader would call their text.
LAYOUTS = {
    "news": ("<div class=bar>The Paper<ul class=k><li><a href=/>World</a><li><a href=/s>Sport</a></ul></div><div class=piece><h1>News {0}</h1><p>It was {0}.</p><h2>Background</h2><p>Since {0}.</p></div><div class=legal>Imprint</div>", "News {0}\n\nIt was {0}.\n\nBackground\n\nSince {0}."),
    "server": ("<form runat=server><table><tr><td>Intranet</td></tr></table><div class=inner><p>Memo {0}</p><p>Do {0}.</p><div class=tip>Print this page</div><p>Then {0}.</p></div><p class=z>Made by IT</p></form>", "Memo {0}\n\nDo {0}.\n\nThen {0}."),
    "blog": ("<div class=brand>My blog</div><div class=entry><h1>Post {0}</h1><p>Dear {0}</p></div><div class=talkback><b>u{0}</b><p>I agree with {0}</p></div><div class=low>Powered by it</div>", "Post {0}\n\nDear {0}"),
    "shop": ("<div class=cart>Basket</div><div class='sidebar layout'><div class=item><h1>Thing {0}</h1><p>Use {0}.</p></div></div><div class=pay>Pay by card</div>", "Thing {0}\n\nUse {0}."),
}


def test_hosts_without_article_elements(spark):
    bodies = [(kind, n, f"<!DOCTYPE html><html><head><title>x</title></head><body>{body.format(n)}</body></html>") for kind, (body, _) in LAYOUTS.items() for n in range(8)]
    df = spark.createDataFrame([(i, f"http://{kind}.org/{n}", text) for i, (kind, n, text) in enumerate(bodies)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_text(df).collect()}
    for i, (kind, n, text) in enumerate(bodies):
        assert found[i] == LAYOUTS[kind][1].format(n), kind
        assert html.extract(text, None) != found[i], kind  # the template decides, not the elements
    mixed = df.withColumn("url", html.F.concat(html.F.lit("http://one.org/"), "page_id"))
    assert {r.page_id: r.text for r in html.main_text(mixed).collect()} == found
