"""Op 3: Myers against the plain matrix; the operator against a scan for every item at every place."""

import random

from palimpsest.llm import decontaminate as dc


def plain(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (c != d)))
        row = new
    return min(row)


def test_distance_against_the_matrix():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        most = rng.randint(0, len(p))
        want, got = plain(p, t), dc.distance(p, t, most)
        assert (got[0] == want) if want <= most else got is None


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("qxz")
        elif kind == 1:
            t.insert(i, rng.choice("qxz"))
        else:
            del t[i]
    return "".join(t)


def test_operator_against_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "of", "ander", "onth", "ouble", "tion", "reheat", "in", "stly"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(25)) for i in range(6)] + [(6, None), (7, "..."), (8, "Short"), (9, prose(25))]
    items.append((10, items[9][1].upper()))
    docs = []
    for d in range(60):
        text = prose(rng.randint(0, 60))
        if d % 3 == 0:
            i, item = items[rng.randrange(6)]
            text += "\n" + edited(rng, item, rng.randint(0, 16)).upper() + "! " + prose(10)
        docs.append((d, text, d))
    docs += [(100, None, 1), (101, "", 1), (102, items[9][1], 1), (102, items[9][1], 1)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, text, _ in docs:
        for n, item in items:
            p, t = dc.normal(item or ""), dc.normal(text or "")
            if p and (e := plain(p, t)) <= int(dc.RATE * len(p)):
                want.append((i, n, e))
    found = dc.contaminated(d, b)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found.collect()) == sorted(want)
    assert len(want) > 15 and any(e for *_, e in want)
    blocks = dc.contaminated(d, b, block=150)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))
    bad = {i for i, *_ in want}
    assert sorted(r.doc_id for r in dc.clean(d, b).collect()) == sorted(i for i, *_ in docs if i not in bad)
    assert dc.contaminated(d, b.limit(0)).count() == 0 and dc.clean(d, b.limit(0)).count() == len(docs)
    assert dc.contaminated(d.limit(0), b).count() == 0


def test_benchmarks_of_many_blocks_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(dc, "HELD", 1)
    rng = random.Random(7)
    items = [(f"i{n}", " ".join(f"{rng.randrange(900)}" for _ in range(20))) for n in range(12)] + [(None, "no id but a text of its own")]
    docs = [(n, f"before {items[n % 13][1]} after") for n in range(26)] + [(90, "nothing"), (91, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = dc.contaminated(d, b, block=200)
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in found.collect()), key=str) == sorted(((n, items[n % 13][0], 0) for n in range(26)), key=str)
    assert sorted(r.doc_id for r in dc.clean(d, b, block=200).collect()) == [90, 91]


def test_very_long_texts(spark):
    item = "a passage of the benchmark that hides in a very long text"
    d = spark.createDataFrame([(1, "word " * 200_000 + item + " end" * 1000)], "doc_id long, text string")
    assert [(r.item_id, r.edits) for r in dc.contaminated(d, spark.createDataFrame([(3, item)], "item_id int, text string")).collect()] == [(3, 0)]
