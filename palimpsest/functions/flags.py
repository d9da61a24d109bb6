"""Risk flags of a vote and its choices' scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSE_MARGIN = 0.05
LOW_TURNOUT = 10


def risk_flags(quorum: Column, total: Column, scores: Column, votes: Column) -> Column:
    """array<string> of quorum, close_vote and low_turnout; a null input raises no flag of its own."""
    ranked = F.sort_array(scores, asc=False)
    margin = (F.element_at(ranked, 1) - F.element_at(ranked, 2)) / total
    return F.array_compact(
        F.array(
            F.when((quorum > 0) & (F.coalesce(total, F.lit(0.0)) < quorum), F.lit("quorum")),
            F.when((F.size(scores) >= 2) & (total != 0), F.when(margin < CLOSE_MARGIN, F.lit("close_vote"))),
            F.when(votes < LOW_TURNOUT, F.lit("low_turnout")),
        )
    )


def choice_scores(choices: Column, scores: Column) -> Column:
    """array<struct<place, choice, score>> by position; a choice without a score has 0."""
    return F.transform(
        choices, lambda c, i: F.struct(i.alias("place"), c.alias("choice"), F.coalesce(F.try_element_at(scores, i + 1), F.lit(0.0)).alias("score"))
    )


def changed_fields(**pairs: tuple[Column, Column]) -> Column:
    """Names of the pairs that differ, nulls equal."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in pairs.items())))
