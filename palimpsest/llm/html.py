"""Main text of web pages by template deduction over the pages of a host.

Tokens are start tags and text nodes, told apart by their path in the page. Tokens that occur equally often on every page
of a host form an equivalence class; large classes that many pages share, whose members keep their order and whose
elements nest around text that fewer pages share, are the host's template. What lies between its tokens are slots. The
slot that holds a page's article is that of the page's content elements or, where it has none, the innermost element of
the template that holds all text which is not the template's. Everything in it is extracted but for boxes of the
template's own text that belong to classes which reach beyond the slot, and for furniture by kind or unmistakable name.
No size of a text decides anything.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut
from palimpsest.shipping import ship

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements that break text into
# blocks, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "summary"}

# Furniture by element; words of a class, id or role that mean furniture, and those of them that can just as
# well name a part of an article.
HIDDEN = frozenset("head script style noscript iframe template svg title textarea select button".split())
SOFT = frozenset("nav footer aside form dialog menu".split())
PLAIN = (
    r"(?:ads?|advert\w*?|banner|sponsor\w*?|promo\w*?|nav\w*?|breadcrumbs?|sidebar|masthead|cookies?|consent|popup|modal|newsletter|"
    r"subscri\w*?|share|social|comments?|replies|disqus|login|readers?|responses?|reactions?|talkback|guestbook)"
)
EITHER = r"(?:menu\w*?|header|footer|notices?|related|search)"
WORD = rf"(?:{PLAIN}|{EITHER})"
#: A name that consists of such words alone, among others; and all names of an element that do, one of them unmistakably.
NAMED = re.compile(rf"(?<!\S){WORD}(?:[_-]+{WORD})*(?!\S)", re.I)
SURELY = re.compile(rf"(?=.*(?<![^\s_-]){PLAIN}(?![^\s_-]))\s*{WORD}(?:[\s_-]+{WORD})*\s*", re.I)
LOOSELY, STRICTLY = 1, 2
CONTENT = frozenset({"article", "main"})
#: An article element of such a name leads to an article and is none; a name of readers' texts, also as an id.
LEADS = re.compile(r"(?<![^\s_-])(?:teasers?|cards?|previews?|related|promos?)(?![^\s_-])", re.I)
READERS = re.compile(r"(?<![^\s_-])(?:comments?|replies|disqus)(?![^\s_-])", re.I)
#: Elements that a name may drop inside the slot; those that make a box of their text there.
NAMEABLE = frozenset("div section ul ol dl table details fieldset center".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
BOX = frozenset("div section aside nav header footer form fieldset address details dialog center menu hgroup".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass(slots=True)
class Node:
    """An element: its parent, tag, path, whether it is furniture by kind, whether it or a parent is a content element, how
    surely its own name makes it furniture, and whether it does even inside an article."""

    parent: int
    tag: str
    path: str
    furniture: bool
    content: bool
    named: int = 0
    sure: bool = False
    token: int = 0


def name(text: str) -> int:
    """A token's number."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Elements in order, and text nodes as (element, text, starts a block), entities decoded, white space as it is."""
    nodes = [Node(-1, "", "", False, False)]
    texts: list[tuple[int, str, bool]] = []
    stack = [0]
    fresh, at, size = True, 0, len(page)

    def pop(k: int) -> None:
        nonlocal fresh
        if any(nodes[i].tag in BLOCK for i in stack[k:]):
            fresh = True
        del stack[k:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            texts.append((stack[-1], entities.unescape(page[at:lt]), fresh))
            fresh = False
            at = lt
            continue
        hit = TAG.match(page, at) or LOOSE.match(page, at)
        if hit is None:
            # A sign that opens no tag is text.
            nxt = page.find("<", at + 1)
            nxt = size if nxt < 0 else nxt
            texts.append((stack[-1], entities.unescape(page[at:nxt]), fresh))
            fresh = False
            at = nxt
            continue
        at = hit.end()
        if hit[2] is None:
            continue
        if not hit[0].endswith(">"):
            break
        tag = hit[2].lower()
        if hit[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    pop(k)
                    break
            if tag in BLOCK:
                fresh = True
            continue
        if tag == "br":
            texts.append((stack[-1], " ", fresh))
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    pop(k)
                    break
                if nodes[stack[k]].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, inside = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in inside:
                    break
                if nodes[stack[k]].tag in ends:
                    pop(k)
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(hit[3])} if hit[3] else {}
        label = tag + "".join(f"[{k}={' '.join(v.split())}]" for k, v in sorted(attributes.items()) if k != "id" or not re.search(r"\d", v))
        up = nodes[stack[-1]]
        names = [attributes[k] for k in ("class", "id", "role") if k in attributes] if tag not in ("html", "body") else []
        named = LOOSELY if any(map(NAMED.search, names)) else 0
        if named and all(map(SURELY.fullmatch, names)):
            named = STRICTLY
        kinds = [attributes[k] for k in ("class", "role") if k in attributes]
        lead = tag == "article" and any(map(LEADS.search, kinds))
        inside = up.content or (tag in CONTENT and not lead) or attributes.get("role") == "main"
        furniture = tag in HIDDEN or (tag in SOFT and not (tag == "dialog" and re.search(r"(?<![\w-])open(?![\w-])", hit[3]))) or (tag == "header" and not up.content)
        sure = tag in NAMEABLE and (named == STRICTLY and bool(kinds) or bool(READERS.fullmatch(attributes.get("id", ""))))
        if tag in BLOCK:
            fresh = True
        nodes.append(Node(stack[-1], tag, f"{up.path}/{label}", furniture, inside, named, sure))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not hit[3].endswith("/") or tag in BLOCK:
            stack.append(len(nodes) - 1)
    return nodes, texts


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_tokens(page: str) -> list[tuple[int, int, int]]:
    """(token, count, first place or -1 for a text) of a page; token 0 stands for the page itself."""
    nodes, texts = parse(page)
    found: dict[int, list[int]] = {0: [1, 0]}
    for i, node in enumerate(nodes[1:], 1):
        node.token = name(node.path)
        entry = found.setdefault(node.token, [0, i])
        entry[0] += 1
    for i, text, _ in texts:
        if text := " ".join(text.split()):
            entry = found.setdefault(name(f"{nodes[i].path}\n{text}"), [0, -1])
            entry[0] += 1
    return [(token, *entry) for token, entry in found.items()]


def templates(pages: DataFrame, share: float = 0.02, members: int = 3) -> DataFrame:
    """A row for each host: host, pages long, template array<struct<class, token, at, n>>, null where it has none.

    ``pages`` has id, host and html. Equal sums of two numbers that a page and a token's count on it determine stand for
    equal occurrence vectors. A class is part of the template if three pages (of hosts of up to four, half of them and
    two), and ``share`` of the host's pages, have it, so that each layout of a host gets its own; if it has ``members``
    tokens or more; and if some are elements, as texts alone enclose nothing. Each page gives a row for each of its
    tokens and all meet in partial sums, so a host of any size costs no task more than others; a template holds at most
    pages' mean tokens / share.
    """
    ship(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for where, key, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for token, count, at in page_tokens(page):
                    mixed = (key * 0x9E3779B97F4A7C15 + count * 0xC2B2AE3D27D4EB4F) % (1 << 64)
                    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
                    mixed ^= mixed >> 32
                    rows.append((where, token, mixed & 0xFFFFFFFF, mixed >> 32, at))
            kinds = [pa.string(), *[pa.int64()] * 4]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "token", "x", "y", "at"])

    rows = pages.select("host", F.xxhash64("id", "html").alias("key"), "html").mapInArrow(
        work, "host string, token long, x long, y long, at long"
    )
    tokens = rows.groupBy("host", "token").agg(
        F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.avg("at").alias("at")
    )
    tokens = cut(tokens.where("token = 0 or n >= 2"))
    size = tokens.where("token = 0").select("host", F.col("n").alias("pages"))
    shared = tokens.where("token <> 0").join(size, "host").where((F.col("n") >= share * F.col("pages")) & ((F.col("n") >= 3) | (F.col("n") >= 0.5 * F.col("pages"))))
    classes = shared.groupBy("host", "n", "x", "y").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("tokens"))
    classes = classes.where((F.size("tokens") >= members) & (F.element_at("tokens", -1)["at"] > 0))
    one = F.transform("tokens", lambda t: F.struct(F.xxhash64("n", "x", "y").alias("class"), t.token.alias("token"), t.at.alias("at"), F.col("n").alias("n")))
    return size.join(classes.groupBy("host").agg(F.flatten(F.collect_list(one)).alias("template")), "host", "left")


@dataclass
class Template:
    """A host's template: the class of every token, its mean place and the pages that have it."""

    tokens: dict[int, tuple[int, float, int]]

    def valid(self, nodes: list[Node], texts: list[tuple[int, str, bool]]) -> tuple[dict[int, int], dict[int, int]]:
        """Elements' tokens, and texts, of the classes that are the template's on this page, each with its class.

        Their members keep the template's order, they nest in each other, and an element of theirs holds text that fewer
        pages have: copies of an article share classes too, but nothing flows through these.
        """
        known = [self.tokens.get(name(f"{nodes[i].path}\n{t}")) if (t := " ".join(text.split())) else None for i, text, _ in texts]
        aside, _ = furniture(nodes, texts, {k: kind[0] for k, kind in enumerate(known) if kind})
        rarest = [float("inf")] * len(nodes)
        for (i, text, _), kind in zip(texts, known, strict=True):
            if text.strip() and not aside[i]:
                rarest[i] = min(rarest[i], kind[2] if kind else 0)
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i].parent
            rarest[up] = min(rarest[up], rarest[i])
        seen: dict[int, list[tuple[float, int, int]]] = {}
        first: set[int] = set()
        around: set[int] = set()
        for i, node in enumerate(nodes[1:], 1):
            if node.token in self.tokens:
                kind, at, n = self.tokens[node.token]
                if rarest[i] < n:
                    around.add(kind)
                if node.token not in first:
                    first.add(node.token)
                    seen.setdefault(kind, []).append((at, i, node.token))
        ordered = []
        for kind, members in seen.items():
            members.sort()
            places = [i for _, i, _ in members]
            if kind in around and places == sorted(places):
                ordered.append((-self.tokens[members[0][2]][2], -len(members), kind))
        where: dict[int, list[int]] = {kind: [] for _, _, kind in ordered}
        for i, node in enumerate(nodes[1:], 1):
            if (own := self.tokens.get(node.token)) and own[0] in where:
                where[own[0]].append(i)
        # Commonest first, a class joins the template if it lies between two members of each one there, or each between
        # two of its own.
        kinds: list[int] = []
        for _, _, kind in sorted(ordered):
            if all(between(where[kind], where[k]) or between(where[k], where[kind]) for k in kinds):
                kinds.append(kind)
        good = {token: kind for kind in kinds for _, _, token in seen[kind]}
        return good, {k: kind[0] for k, kind in enumerate(known) if kind and kind[0] in kinds}


def between(inner: list[int], outer: list[int]) -> bool:
    """Whether all of ``inner`` lies in one gap of ``outer``, or before or after it; both in order."""
    return bisect(outer, inner[0]) == bisect(outer, inner[-1])


def extract(page: str, template: Template | None) -> str:
    """The article's blocks, joined by blank lines."""
    nodes, texts = parse(page)
    if template:
        for node in nodes[1:]:
            node.token = name(node.path)
    good, fixed = template.valid(nodes, texts) if template else ({}, {})
    dropped, kept = furniture(nodes, texts, fixed)

    def own(skip: list[bool]) -> list[int]:
        """Characters of text under each element that isn't the template's and isn't dropped."""
        mass = [0] * len(nodes)
        for k, (i, text, _) in enumerate(texts):
            mass[i] += 0 if k in fixed or skip[i] else len(text.strip())
        for i in range(len(nodes) - 1, 0, -1):
            mass[nodes[i].parent] += mass[i]
        return mass

    # The slot of the article: the page's content elements; else the innermost element of the template with all text
    # that isn't the template's; else the page.
    mass = own(dropped)
    roots = [i for i, n in enumerate(nodes) if n.content and not nodes[n.parent].content and not dropped[i] and (mass[i] or not good)]
    if not roots and good:
        roots = [i for i, n in enumerate(nodes) if n.token in good and not dropped[i] and mass[i] and mass[i] == mass[0]][-1:]
    inside = [not roots] * len(nodes)
    # In a slot that is less than the whole body, a name drops only what it names beyond doubt or the template has there.
    sure = bool(roots) and all(nodes[i].tag not in ("html", "body") for i in roots)
    for i in range(1, len(nodes)):
        n, up = nodes[i], nodes[i].parent
        inside[i] = inside[up] or i in roots
        if sure and inside[up]:
            dropped[i] = dropped[up] or (i not in kept and (n.furniture or n.sure or (n.named == LOOSELY and n.tag in NAMEABLE and n.token in good)))
    gone = furnished(nodes, texts, good, fixed, roots, inside, dropped, own(dropped)) if fixed else set()
    blocks: list[list[str]] = []
    new = True
    for k, (i, text, fresh) in enumerate(texts):
        new |= fresh
        if not inside[i] or dropped[i] or k in gone:
            new = True
            continue
        if new:
            blocks.append([])
            new = False
        blocks[-1].append(text)
    found = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in found if b)


def furnished(nodes: list[Node], texts: list[tuple[int, str, bool]], good: dict[int, int], fixed: dict[int, int], roots: list[int], inside: list[bool], dropped: list[bool], mass: list[int]) -> set[int]:
    """The template's texts that are no part of the article though they stand in its slot.

    A class that lies in the slot alone is one of articles that say the same, and stays. Of the others (menus, notices: what
    also stands around the slot), a box of nothing but the template's text goes, wherever it stands; headings, paragraphs
    and the like go only before or after all of the page's own text.
    """
    around = set()
    for i in roots:
        while i:
            around.add(i)
            i = nodes[i].parent
    beyond = {good[n.token] for i, n in enumerate(nodes) if n.token in good and not inside[i] and i not in around}
    beyond |= {kind for k, kind in fixed.items() if not inside[texts[k][0]]}
    mine = [k for k, (i, text, _) in enumerate(texts) if k not in fixed and inside[i] and not dropped[i] and text.strip()]
    out = set()
    for k, kind in fixed.items():
        i = texts[k][0]
        if not inside[i] or (roots and kind not in beyond):
            continue
        while i not in roots and nodes[i].parent > 0 and inside[nodes[i].parent] and nodes[i].parent not in roots and not mass[nodes[i].parent]:
            i = nodes[i].parent
        box = i not in roots and not mass[i] and nodes[i].tag in BOX
        if box or not mine or not mine[0] < k < mine[-1]:
            out.add(k)
    return out


def furniture(nodes: list[Node], texts: list[tuple[int, str, bool]], fixed: dict[int, int]) -> tuple[list[bool], set[int]]:
    """Which elements are furniture by kind or name, or lie in such; and those that are not, though they look so, as they
    hold what the page is for.

    That is the content elements, where none stands outside furniture; without any, the first-level headings, where a name
    or a form holds all of them; without these, all of the page's own text: then names give way first, forms next, those that
    hold paragraphs or headings before others.
    """
    marks = [2 if n.furniture and n.tag != "form" else 1 if n.furniture or n.named == STRICTLY else 0 if n.named else -1 for n in nodes]
    hidden = [n.tag in HIDDEN for n in nodes]
    tops = [i for i, n in enumerate(nodes[1:], 1) if n.content and not nodes[n.parent].content]
    for i in tops:
        marks[i] = 2 if nodes[i].furniture else -1
    kept: set[int] = set()

    def spread() -> list[bool]:
        out = [False] * len(nodes)
        for i in range(1, len(nodes)):
            out[i] = out[nodes[i].parent] or hidden[i] or (marks[i] >= 0 and i not in kept)
        return out

    def release(held: list[int], most: int) -> None:
        """What holds these elements is no furniture, up to a rank, but for what is hidden."""
        for i in held:
            while i > 0:
                if 0 <= marks[i] <= most and not hidden[i]:
                    kept.add(i)
                i = nodes[i].parent

    dropped = spread()
    heads = [i for i, n in enumerate(nodes) if n.tag == "h1"]
    if tops and all(dropped[i] for i in tops):
        release(tops, 2)
        dropped = spread()
    elif not tops and heads and all(dropped[i] for i in heads):
        release(heads, 1)
        dropped = spread()
    own = [i for k, (i, text, _) in enumerate(texts) if k not in fixed and text.strip()]
    prose = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        prose[i] |= nodes[i].tag in PROSE
        prose[nodes[i].parent] |= prose[i]
    for written, rank in ((True, 0), (True, 1), (False, 0), (False, 1)):
        if own and not tops and all(dropped[i] for i in own):
            outer = [i for i in range(1, len(nodes)) if dropped[i] and not dropped[nodes[i].parent] and 0 <= marks[i] <= rank and not hidden[i]]
            kept.update(i for i in outer if prose[i] or not written)
            dropped = spread()
    return dropped, kept


#: Tokens of templates that are sent to every executor whole (some 64 bytes each); beyond, pages meet their host's template
#: in a shuffle.
HELD = 1_000_000
#: A host of more than this share of all pages is split into as many parts as it has such shares.
HOT = 200


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", held: int = HELD) -> DataFrame:
    """id, url and text string: the main text of every page, a row for each row of ``pages``.

    Null and empty pages have empty text; pages of a null or odd URL share the host ''. Hosts of one page, or whose pages
    share no template, go by elements alone. Rows that repeat give rows that repeat; other columns don't take part; an
    empty table gives an empty result.

    Templates of up to ``held`` tokens in all are broadcast, and pages stay where they are. Larger ones are dealt out with
    the pages by host, hot hosts in parts that each get a copy, and each part's pages stream past its template.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("host", host(F.col("url")))
    made = cut(templates(rows))
    total, tokens = made.agg(F.sum("pages"), F.sum(F.size("template"))).first()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string"

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    def template(found: list) -> Template | None:
        return Template({t["token"]: (t["class"], t["at"], t["n"]) for t in found}) if found else None

    if (tokens or 0) <= held:
        known = spark.sparkContext.broadcast({r.host: template(r.template) for r in made.where("template is not null").toLocalIterator()})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts = batch.column(3).to_pylist()
                yield result(batch, [extract(page, known.value.get(h)) for page, h in zip(batch.column(2).to_pylist(), hosts, strict=True)])

        done = rows.mapInArrow(work, schema)
    else:
        # Fewer than HOT hosts are larger than this.
        hot = F.broadcast(made.where(F.col("pages") * HOT > total).select("host", F.ceil(F.col("pages") * HOT / total).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        dealt = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("id", "html"), parts).cast("int"))
        copies = made.where("template is not null").join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = copies.select("host", "part", F.lit(0).alias("role"), "template").unionByName(
            dealt.select("id", "url", "html", "host", "part", F.lit(1).alias("role")), allowMissingColumns=True
        )

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, mine = None, None
            for batch in batches:
                hosts, roles, htmls = (batch.column(k).to_pylist() for k in (3, 4, 2))
                pages, texts = [], []
                for k, role in enumerate(roles):
                    if role == 0:
                        now, mine = hosts[k], template(batch.column(5)[k].as_py())
                    else:
                        pages.append(k)
                        texts.append(extract(htmls[k], mine if hosts[k] == now else None))
                yield result(batch.take(pa.array(pages, pa.int64())), texts)

        both = both.repartition("host", "part").sortWithinPartitions("host", "part", "role")
        done = both.select("id", "url", "html", "host", "role", "template").mapInArrow(stream, schema)
    return done.select(F.col("id").alias(id), F.col("url").alias(url), "text")
