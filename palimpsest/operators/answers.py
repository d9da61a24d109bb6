"""The deterministic shell around models: routing, relevance, citations, gaps, scoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import chunk_ref
from palimpsest.shipping import ship

ROUTES, SCOPES, SOURCES = ("sql", "vector", "hybrid"), ("one", "all"), ("proposal", "forum")
#: White space that a model may put around a word.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTEXT, RELEVANT, PREVIEW_ROWS, PREVIEW_CHARS = 24, 2, 25, 900
GAP = "DATA GAP IDENTIFIED — the corpus does not contain material that answers this question."


def normalise_routes(raw: DataFrame, protocols: list[str]) -> DataFrame:
    """Model output coerced to route, scope, protocol, source, since and reason; whatever is odd takes a safe default.

    A named protocol narrows the scope to one unless the route is sql. ``raw`` has these columns as strings.
    """
    low = lambda c: F.lower(F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(BLANKS)))
    route = F.when(low("route").isin(*ROUTES), low("route")).otherwise("vector")
    scope = F.when(low("scope").isin(*SCOPES), low("scope")).otherwise("all")
    protocol = F.when(F.lower("protocol").isin(*protocols), F.lower("protocol"))
    since = F.when((F.length("since") == 10) & (F.substring("since", 5, 1) == "-"), F.col("since"))
    staged = raw.withColumns({"route": route, "scope": scope, "protocol": protocol, "since": since, "source": F.when(F.col("source").isin(*SOURCES), F.col("source")), "reason": F.substring(F.coalesce("reason", F.lit("")), 1, 120)})
    narrow = F.col("protocol").isNotNull() & (F.col("scope") == "all") & (F.col("route") != "sql")
    return staged.withColumn("scope", F.when(narrow, "one").otherwise(F.col("scope")))


def normalise_route(raw: dict[str, Any], protocols: list[str]) -> dict[str, Any]:
    """``normalise_routes`` for one question on the driver."""
    text = lambda k: str(raw.get(k) or "").strip(BLANKS).lower()
    named = raw["protocol"].lower() if isinstance(raw.get("protocol"), str) and raw["protocol"].lower() in protocols else None
    route = text("route") if text("route") in ROUTES else "vector"
    scope = text("scope") if text("scope") in SCOPES else "all"
    since = raw.get("since")
    return {
        "route": route,
        "scope": "one" if named and route != "sql" else scope,
        "protocol": named,
        "source": raw.get("source") if raw.get("source") in SOURCES else None,
        "since": since if isinstance(since, str) and len(since) == 10 and since[4] == "-" else None,
        "reason": str(raw.get("reason", ""))[:120],
    }


def wanted(route: str, scope: str) -> int:
    """How many rows a route retrieves."""
    return 5 if route == "vector" and scope == "one" else 20


def marked(hits: DataFrame, tie: str = "vec_id", by: list[str] | None = None) -> DataFrame:
    """The first CONTEXT hits with marker c0, c1 .. by distance."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("distance", tie) if by else Window.orderBy("distance", tie)
    numbered = hits.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") < CONTEXT)
    return numbered.withColumn("marker", F.concat(F.lit("c"), F.col("__i").cast("string"))).drop("__i")


def markers(answer: Column) -> Column:
    """Markers cited in a text, in order of first use, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(c\d+)\]"), 1))


def resolve_citations(answers: DataFrame, passages: DataFrame, answer: str = "answer", by: list[str] | None = None) -> DataFrame:
    """Every cited marker with its passage: by.., place, marker, chunk_ref, distance, problem (null if it resolves).

    ``passages`` has marker, source, document_id, chunk_index and distance, and those of ``by`` that tell apart answers
    with passages of their own.
    """
    by = by or []
    own = [c for c in by if c in passages.columns]
    cited = answers.select(*by, F.posexplode(markers(F.col(answer))).alias("place", "marker"))
    found = passages.select(*own, "marker", chunk_ref(F.col("source"), F.col("document_id").cast("string"), F.col("chunk_index")).alias("chunk_ref"), F.round("distance", 4).alias("distance"))
    missing = F.concat(F.lit("["), F.col("marker"), F.lit("] does not match any retrieved passage"))
    return cited.join(found, [*own, "marker"], "left").select(*by, "place", "marker", "chunk_ref", "distance", F.when(F.col("chunk_ref").isNull(), missing).alias("problem"))


def keep_relevant(passages: DataFrame, scores: DataFrame, on: list[str], least: int = RELEVANT) -> DataFrame:
    """Passages whose score is ``least`` or more; a passage without one has 0."""
    return passages.join(scores.select(*on, F.col("score").alias("__s")), on, "left").where(F.coalesce("__s", F.lit(0)) >= least).drop("__s")


def score_passages(pairs: DataFrame, judge: Callable[[list[str], list[str]], list[int]], question: str = "question", text: str = "text") -> DataFrame:
    """``pairs`` with score int from an injected ``judge`` of questions and passages, batch by batch."""
    ship(pairs.sparkSession)

    @F.pandas_udf("int")
    def work(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series(judge(questions.tolist(), texts.str.slice(0, PREVIEW_CHARS).tolist()), dtype="int32")

    return pairs.withColumn("score", work(F.col(question), F.col(text)))


def overlap_judge(questions: list[str], texts: list[str]) -> list[int]:
    """The offline judge: 0 to 3 by the share of a question's longer words that a passage holds."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        words = {w for w in re.findall(r"\w+", (q or "").lower()) if len(w) > 3}
        held = words & set(re.findall(r"\w+", (t or "").lower()))
        out.append(round(3 * len(held) / len(words)) if words else 0)
    return out


def is_gap(relevant: int, rows: int) -> bool:
    """Neither passages nor structured rows: say so instead of answering."""
    return not relevant and not rows


def recall(expected: DataFrame, retrieved: DataFrame, question: str, key: list[str]) -> DataFrame:
    """expected, matched and recall by question; both inputs are taken as sets."""
    want = expected.select(question, *key).distinct()
    got = retrieved.select(question, *key).distinct().withColumn("__hit", F.lit(1))
    found = want.join(got, [question, *key], "left").groupBy(question).agg(F.count("*").alias("expected"), F.count("__hit").alias("matched"))
    return found.withColumn("recall", F.col("matched") / F.col("expected"))


def recall_summary(scores: DataFrame) -> DataFrame:
    """micro (found over expected) and macro (mean by question) recall; 0 without questions."""
    return scores.agg(*_recalls())


def _recalls() -> list[Column]:
    # Negative questions have no recall, and what they expect doesn't count.
    total = lambda c: F.coalesce(F.sum(F.when(F.col("recall").isNotNull(), F.col(c))), F.lit(0))
    micro = total("matched") / F.greatest(total("expected"), F.lit(1))
    return [micro.alias("micro"), (F.coalesce(F.sum("recall"), F.lit(0.0)) / F.greatest(F.count("recall"), F.lit(1))).alias("macro")]


NEGATIVE = "negative"


def score_questions(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, gated: DataFrame, question: str, key: list[str], least: int = RELEVANT) -> DataFrame:
    """A row for each question: question, kind, expected, matched, recall, answerable, leaked, judge_leaked, passed.

    ``questions`` has question and kind; ``retrieved`` is what a search without cut-offs gave, ``gated`` what it gave with
    them, with a judge's score of each passage (null: 0). Positive questions pass if all that is expected was retrieved,
    and are answerable if the cut-offs leave anything. Negative ones pass if no passage that the cut-offs leave (leaked)
    is relevant to the judge (judge_leaked).
    """
    found = recall(expected, retrieved, question, key)
    left = gated.groupBy(question).agg(F.count("*").alias("leaked"), F.count_if(F.coalesce("score", F.lit(0)) >= least).alias("judge_leaked"))
    none, negative = F.lit(0).cast("long"), F.col("kind") == NEGATIVE
    rows = questions.select(question, "kind").join(found, question, "left").join(left, question, "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("expected", "matched", "leaked", "judge_leaked")})
    return rows.select(
        question,
        "kind",
        "expected",
        "matched",
        F.when(~negative, F.coalesce("recall", F.lit(0.0))).alias("recall"),
        F.when(~negative, F.col("leaked") > 0).alias("answerable"),
        "leaked",
        "judge_leaked",
        F.when(negative, F.col("judge_leaked") == 0).otherwise(F.col("matched") == F.col("expected")).alias("passed"),
    )


def evaluation(scored: DataFrame) -> DataFrame:
    """One row over ``score_questions``: micro, macro, positives, survived (answerable), negatives, clean (no relevant
    passage) and prefilter_clean (none past the cut-offs)."""
    negative = F.col("kind") == NEGATIVE
    return scored.agg(
        *_recalls(),
        F.count_if(~negative).alias("positives"),
        F.count_if(F.coalesce("answerable", F.lit(False))).alias("survived"),
        F.count_if(negative).alias("negatives"),
        F.count_if(negative & F.col("passed")).alias("clean"),
        F.count_if(negative & (F.col("leaked") == 0)).alias("prefilter_clean"),
    )


def recall_by_kind(scored: DataFrame) -> DataFrame:
    """Mean recall and the number of questions of every kind but the negative."""
    return scored.where(F.col("kind") != NEGATIVE).groupBy("kind").agg(F.avg("recall").alias("recall"), F.count("*").alias("questions"))


def routing_accuracy(scored: DataFrame, got: str = "got_route", expected: str = "expected_route") -> DataFrame:
    """Accuracy by expected route, and overall in the row whose route is null."""
    ok = F.avg(F.col(got).eqNullSafe(F.col(expected)).cast("double"))
    return scored.groupingSets([[F.col(expected)], []], F.col(expected)).agg(F.count("*").alias("questions"), ok.alias("accuracy"))


def scope_accuracy(scored: DataFrame, got: str = "got_scope", expected: str = "expected_scope") -> DataFrame:
    """The same by scope, over the questions that expect one."""
    return routing_accuracy(scored.where(F.col(expected).isNotNull()), got, expected)


def resolve_labels(rows: DataFrame, labels: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their label and resolved boolean; labels are one for each key."""
    known = labels.select(*key, *columns, F.lit(True).alias("resolved"))
    return rows.join(known, key, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def unresolved(resolved: DataFrame) -> DataFrame:
    """One row: rows and how many of them have no label."""
    return resolved.agg(F.count("*").alias("rows"), F.count_if(~F.col("resolved")).alias("unresolved"))
