"""Op 5 against brute force over all runs of lines."""

import random

import pytest

from palimpsest.llm import linededup as ld


def plain(docs, min_words):
    """The lines to drop by (id, text): every run of enough words that occurs at an earlier place."""
    lines = {(i, t): t.split("\n") for i, t in docs if t}
    order = sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0))
    drop = {k: set() for k in order}
    seen = {}
    for rank, k in enumerate(order):
        rows = lines[k]
        for a in range(len(rows)):
            words = 0
            for b in range(a, len(rows)):
                words += rows[b].count(" ") + 1
                run = tuple(rows[a : b + 1])
                if words >= min_words:
                    if run in seen and seen[run] < (rank, a):
                        drop[k] |= set(range(a, b + 1))
                    seen.setdefault(run, (rank, a))
    return drop


def check(spark, docs, min_words):
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, at long")
    want = plain(docs, min_words)
    found = ld.dedup_lines(df, min_words=min_words).collect()
    assert len(found) == len(docs)
    originals = {i: t for i, t in docs}
    for r in found:
        t = originals[r.doc_id]
        gone = want.get((r.doc_id, t), set())
        assert set(r.dropped) == gone, (r.doc_id, r.dropped, gone)
        assert r.text == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
        assert r.n_lines == (len(t.split("\n")) if t else 0)
    return sum(map(len, want.values()))


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["", "x"]
    for min_words in (1, 7, 20):
        docs = []
        for i in range(30):
            rows = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
            if i % 4 == 0:
                rows += [f"own {i} {rng.random()}"]
            if docs and rng.random() < 0.4:
                source = (rng.choice(docs)[1] or "").split("\n")
                a = rng.randrange(len(source))
                rows += source[a : a + rng.randint(1, 9)]
            docs.append((i, "\n".join(rows)))
        docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "z " * 400)]
        assert check(spark, docs, min_words) > 10


def test_long_runs_of_short_lines(spark):
    song = "\n".join(f"l{i % 5}" for i in range(70))
    assert check(spark, [(1, song), (2, "head\n" + song + "\ntail"), (3, "\n".join(["la"] * 130))], 50) > 100


def test_short_boilerplate_stays(spark):
    docs = [(i, f"own line {i}\nLicensed under the licence.") for i in range(5)]
    assert check(spark, docs, 50) == 0


def test_repeated_rows_null_ids_and_nothing(spark):
    long = "word " * 60 + "end"
    df = spark.createDataFrame([(4, long), (4, long), (None, long), (9, long + "\nmore")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in ld.dedup_lines(df).collect()), key=str)
    assert found == sorted([(4, ""), (4, ""), (None, long), (9, "more")], key=str)
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_very_common_lines_and_very_long_texts(spark):
    line = " ".join("abcdefghij")
    docs = [(i, "\n".join([line] * 6 + [f"own {i}"])) for i in range(60)] + [(100, "\n".join(f"x {i % 3000} y" for i in range(6500)))]
    assert check_large(spark, docs) > 59 * 6


def check_large(spark, docs):
    """Against the longest earlier copies by hashing of each window of just enough lines, forwards and backwards."""
    drop = {}
    for d, t in docs:
        rows = t.split("\n")
        words = [r.count(" ") + 1 for r in rows]
        for step in (1, -1):
            for a in range(len(rows)):
                b, n = a, 0
                while 0 <= b < len(rows) and n < ld.MIN_WORDS:
                    n += words[b]
                    b += step
                if n >= ld.MIN_WORDS:
                    lo, hi = (a, b) if step > 0 else (b + 1, a + 1)
                    drop.setdefault(tuple(rows[lo:hi]), set()).add((d, lo))
    gone = {d: set() for d, _ in docs}
    for run, places in drop.items():
        for d, lo in sorted(places)[1:]:
            gone[d] |= set(range(lo, lo + len(run)))
    found = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        assert found[d].dropped == sorted(gone[d])
        assert found[d].text == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
    return sum(map(len, gone.values()))


def test_intervals_of_the_array_may_span_parts(spark):
    rows = [(d, a, 2, d % 3 // 2, 7) for d in range(40) for a in range(25)]
    df = spark.createDataFrame(rows, "doc long, at int, n int, cl long, cr long").repartition(7)
    found = sorted((r.doc, r.at) for r in ld._copies(df).collect())
    assert found == sorted((d, a) for d, a, *_ in rows if (d, a) not in ((0, 0), (2, 0)))


def test_clashing_names_are_errors(spark):
    for name in ("n_lines", "__drop", "__Lines"):
        with pytest.raises(ValueError):
            ld.dedup_lines(spark.createDataFrame([(1, "a", 1)], f"doc_id long, text string, `{name}` int"))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a b\nc")], "doc_id long, text string")
    plan = ld.dedup_lines(df, min_words=1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
