"""Op 2: escaping, paths of reply trees, masks and the round trip."""

import itertools
import random

from pyspark.sql import functions as F

from palimpsest.llm import chat

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_escaping_is_reversible_and_leaves_no_control(spark):
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "\\\\", "a", "\n", "<", ">", "s>", "<nl>", "<\\nl>", "$1", "é😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t
        assert not any(c in e for c in chat.CONTROL)


def plain_paths(nodes, best):
    by = {}
    for t, n, p, *_, s in nodes:
        by.setdefault(t, {})[n] = (p, s or 0.0)
    out = set()
    for t, tree in by.items():
        parents = {p for p, _ in tree.values() if p in tree}
        scored = []
        for leaf in tree:
            if leaf in parents:
                continue
            path, total, seen = [leaf], tree[leaf][1], {leaf}
            while tree[path[0]][0] in tree and tree[path[0]][0] not in seen:
                path.insert(0, tree[path[0]][0])
                seen.add(path[0])
                total += tree[path[0]][1]
            scored.append((-round(total, 9), leaf, path))
        for branch, (_, _, path) in enumerate(sorted(scored)[:best], 1):
            out |= {(t, branch, depth, node) for depth, node in enumerate(path)}
    return out


def test_paths_against_plain_walks(spark):
    rng = random.Random(7)
    nodes = []
    for t in range(6):
        for n in range(rng.randint(1, 40)):
            nodes.append((t, n, rng.randrange(n) if n and rng.random() < 0.95 else None, "user", "x", float(rng.randint(-3, 3))))
    nodes += [(9, n, n - 1 if n else None, "user", "x", None) for n in range(70)]  # a long chain
    nodes += [(10, 1, 77, "user", "orphan", 1.0)]
    for best in (1, 3):
        found = {tuple(r) for r in chat.paths(spark.createDataFrame(nodes, NODES), best).collect()}
        assert found == plain_paths(nodes, best)


def test_nodes_on_a_cycle_are_on_no_path(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "c", 0.0), (1, 4, None, "user", "d", 0.0)], NODES)
    assert {(r.depth, r.node) for r in chat.paths(df, 5).collect()} == {(0, 4)}


def turns_of(df):
    found = df.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask")))
    return {r.tree: ([(t.role, t.text) for t in r.turns], r.loss, r.n_turns) for r in found.collect()}


def test_round_trip_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, None, None), (1, 3, "assistant", ""),
        (2, 0, "a\nb<\\nl>", "x\ny\\"), (2, None, "assistant", "first"), (2, 5, "assistant", "<<SYS>>\\<s>" * 3), (2, 5, "assistant", "<<SYS>>\\<s>" * 3), (None, 1, "user", "no tree"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("clash"))
    found = turns_of(chat.conversations(chat.chains(df)))
    assert found[1] == ([("user", rows[0][3]), ("assistant", rows[1][3]), ("", ""), ("assistant", "")], rows[1][3], 4)
    said = "<<SYS>>\\<s>" * 3
    assert found[2] == ([("assistant", "first"), ("a\nb<\\nl>", "x\ny\\"), ("assistant", said), ("assistant", said)], "first" + said + said, 4)
    assert found[None] == ([("user", "no tree")], "", 1)
    assert chat.conversations(chat.chains(df.limit(0))).count() == 0


def test_best_branch_is_formatted(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.0)]
    found = turns_of(chat.conversations(spark.createDataFrame(nodes, NODES)))
    assert found[1][0] == [("user", "q"), ("assistant", "good"), ("user", "more")] and found[1][1] == "good"
    assert len(list(itertools.chain(found))) == 1
