"""Chat formatting of reply trees: iterative self-joins find root-to-leaf paths, the best scored become conversations.

A turn is ``<s>role\\ntext</s>\\n``. Control strings inside roles and texts get a backslash after their first character,
and backslashes are doubled, so formatting is reversible and a text can never open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch

# The strings that a chat model may read as control.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = "<s>", "</s>\n"

#: A line break in a role, which ends at the first. No escaped text holds this: ``<nl>`` is no control string.
BREAK = "<\\nl>"

#: The same as CONTROL, with what goes before and after the backslash as groups.
PATTERN = r"(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), PATTERN, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: tree, node, parent, role, text, score; each turn answers the one before.

    Null roles and texts are empty. Rows with the same turn number follow each other by role and text, so repeated rows
    are turns of their own; a null turn number comes first.
    """
    rows = turns.select(
        F.col(tree).alias("tree"),
        F.col(order).alias("at"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    by = Window.partitionBy("tree").orderBy("at", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(by).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of every tree: tree, branch, depth, node.

    ``nodes`` has tree, node (unique in its tree), parent and score. A path's score is the sum of its nodes' (null: 0);
    equal scores rank by the leaf's node. A parent that is null or not in the tree makes a root; nodes on or under a
    cycle have no root and are on no path. Every self-join doubles the distance that a node looks up, so a tree of
    depth d takes about log2(d) rounds up and as many down, and no join key is a tree alone. All rounds live in one
    table with a column ``level``, so plans stay the same size however many there are.
    """
    spark, folder = nodes.sparkSession, scratch(nodes.sparkSession, "paths")

    def put(rows: DataFrame, name: str, *by: str) -> int:
        # How many of the rows still look up.
        seen = Observation()
        rows = rows.observe(seen, F.count_if(F.col("up").isNotNull()).alias("n"))
        rows.write.mode("append").partitionBy(*by).parquet(f"{folder}/{name}")
        return seen.get["n"]

    def table(name: str) -> DataFrame:
        return spark.read.schema(kinds[name]).parquet(f"{folder}/{name}")

    start = nodes.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"))
    key = [(n, start.schema[n].dataType.simpleString()) for n in ("tree", "node")]
    up = ", ".join(f"{n} {t}" for n, t in (*key, ("up", key[1][1])))
    kinds = {
        "nodes": f"{up}, score double",
        "jumps": f"{up}, score double, dist long, level int, done boolean",
        "found": f"{up}, branch int, depth long, round int",
    }
    put(start, "nodes")
    known = table("nodes").select(F.col("tree").alias("t"), F.col("node").alias("n"))
    level = (
        table("nodes")
        .join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
        .select("tree", "node", F.col("n").alias("up"), "score", F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long").alias("dist"))
    )
    # Nodes whose look-up has reached a root are done and only serve others. On a cycle it never does, but no path
    # without one is longer than the nodes that looked up at first.
    last = 0
    moving = most = put(level.withColumns({"level": F.lit(0), "done": F.col("up").isNull()}), "jumps", "level", "done")
    while moving and 1 << last <= most:
        far = table("jumps").where(F.col("done") | (F.col("level") == last))
        far = far.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("dist").alias("d2"))
        near = table("jumps").where((F.col("level") == last) & ~F.col("done"))
        level = near.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("dist") + F.col("d2")).alias("dist")
        )
        last += 1
        moving = put(level.withColumns({"level": F.lit(last), "done": F.col("up").isNull()}), "jumps", "level", "done")
    first = table("jumps").where(F.col("level") == 0)
    parents = first.where(~F.col("done")).select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = table("jumps").where("done").join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best)
    put(chosen.select("tree", "node", "up", "branch", F.col("dist").alias("depth"), F.lit(last).alias("round")), "found", "round")
    for k in range(last - 1, -1, -1):
        # Everything found jumps up 2^k places, from where there are as many.
        there = table("found").where(F.col("depth") >= 1 << k)
        jump = table("jumps").where((F.col("level") == k) & ~F.col("done")).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to"))
        more = there.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        more = more.select("tree", F.col("to").alias("node"), "up", "branch", (F.col("depth") - (1 << k)).alias("depth"), F.lit(k).alias("round"))
        put(more, "found", "round")
    return table("found").select("tree", "branch", "depth", "node")


def conversations(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The best paths of every tree as text: tree, branch, n_turns, formatted, mask.

    ``mask`` lists (first, size) in code points, counting from 1, of what assistants say: the text under the loss, as it
    stands in ``formatted``. A conversation is one row, so it must fit in one; trees are not otherwise gathered.
    """
    turns = paths(nodes, best).withColumnsRenamed({"tree": "t", "node": "n"})
    said = nodes.select("tree", "node", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    said = said.join(turns, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(OPEN), F.replace("r", F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), "x", (F.col("role") == "assistant").alias("loss"))
    gathered = said.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.length(t.head) + F.length(t.x) + len(CLOSE)
    mask = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<first:int,size:int>>").alias("mask")),
        lambda a, t: F.struct(
            (a.at + size(t)).alias("at"),
            F.when(t.loss, F.concat(a.mask, F.array(F.struct((a.at + F.length(t.head)).alias("first"), F.length(t.x).alias("size")))))
            .otherwise(a.mask)
            .alias("mask"),
        ),
    )
    return gathered.select(
        "tree",
        "branch",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.x, F.lit(CLOSE))), "").alias("formatted"),
        mask.mask.alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, F.lit("<s>"))
    turns = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        end = F.instr(part, "\n")
        role = F.substring(part, F.lit(1), end - 1)
        text = F.substring(part, end + 1, F.length(part) - end - len(CLOSE))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["first"], m["size"]))), "")
