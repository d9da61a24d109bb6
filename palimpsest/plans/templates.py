"""Named, parameterised queries over the version tables. Each validates its parameters and returns a lazy frame."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES, FIELDS, DIRECTIONS = ("active", "closed", "pending"), ("vote_count", "scores_total"), ("ASC", "DESC")
ID = re.compile(r"[0-9a-zA-Z:_.\-]{1,128}")


class TemplateError(ValueError):
    """A parameter that a template does not take."""


def one_of(name: str, value: Any, allowed: tuple[str, ...], lower: bool = False) -> str:
    found = str(value).lower() if lower else value
    if found not in allowed:
        raise TemplateError(f"{name} must be one of {allowed}, not {value!r}")
    return found


def whole(name: str, value: Any, default: int, low: int, high: int | None = None) -> int:
    """A whole number kept within bounds; null is the default."""
    if value is None:
        return default
    if isinstance(value, bool):
        raise TemplateError(f"{name} is a number")
    try:
        n = int(value)
    except (TypeError, ValueError) as e:
        raise TemplateError(f"{name} is a number, not {value!r}") from e
    return max(low, n if high is None else min(n, high))


def identifier(value: Any) -> str:
    if not isinstance(value, str) or not ID.fullmatch(value):
        raise TemplateError(f"no identifier: {value!r}")
    return value


def day(value: Any) -> datetime | None:
    """A date or ISO time, parsed before any engine sees it."""
    if value is None or isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value))
    except ValueError as e:
        raise TemplateError(f"no date: {value!r}") from e


class Templates:
    """The queries over a proposals and a posts table; ``protocols`` are the names a filter may take."""

    def __init__(self, proposals: DataFrame, posts: DataFrame | None = None, protocols: tuple[str, ...] = ("aave", "uniswap", "arbitrum", "optimism", "ens"), states: tuple[str, ...] = STATES):
        self.all, self.posts, self.protocols, self.states = proposals, posts, protocols, states
        self.registry: dict[str, tuple[str, Callable[..., DataFrame]]] = {
            "count_proposals": ("Count proposals, by protocol and state.", self.count_proposals),
            "count_by_protocol": ("How many proposals each protocol has.", self.count_by_protocol),
            "top_proposals_by": ("Highest proposals by vote_count or scores_total.", self.top_proposals_by),
            "proposal_date_extreme": ("Earliest or latest proposals by creation.", self.proposal_date_extreme),
            "forum_volume": ("Posts and topics of each protocol.", self.forum_volume),
            "list_proposals": ("A page of proposals, newest first.", self.list_proposals),
            "get_proposal": ("One current proposal.", self.get_proposal),
            "get_proposal_history": ("Every version of one proposal, oldest first.", self.get_proposal_history),
        }

    @property
    def now(self) -> DataFrame:
        return self.all.where("is_current")

    def render(self, name: str, params: dict[str, Any] | None = None) -> DataFrame:
        if name not in self.registry:
            raise TemplateError(f"unknown template {name!r}; known: {sorted(self.registry)}")
        run = self.registry[name][1]
        taken = set(run.__code__.co_varnames[1 : run.__code__.co_argcount])
        return run(**{k: v for k, v in (params or {}).items() if k in taken})

    def catalogue(self) -> str:
        return "\n".join(f"- {n}({', '.join(r.__code__.co_varnames[1 : r.__code__.co_argcount]) or 'no params'}): {d}" for n, (d, r) in self.registry.items())

    def _narrow(self, protocol: Any, state: Any) -> DataFrame:
        df = self.now
        if protocol is not None:
            df = df.where(F.col("protocol_name") == one_of("protocol", protocol, self.protocols, lower=True))
        if state is not None:
            df = df.where(F.col("proposal_state") == one_of("state", state, self.states, lower=True))
        return df

    def count_proposals(self, protocol: Any = None, state: Any = None) -> DataFrame:
        return self._narrow(protocol, state).groupBy("protocol_name", "proposal_state").agg(F.count("*").alias("n")).orderBy("protocol_name", "proposal_state")

    def count_by_protocol(self) -> DataFrame:
        return self.now.groupBy("protocol_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "protocol_name")

    def top_proposals_by(self, field: Any = None, limit: Any = None) -> DataFrame:
        by = one_of("field", field, FIELDS)
        rows = self.now.orderBy(F.col(by).desc_nulls_last(), "proposal_id").limit(whole("limit", limit, 10, 1, 100))
        return rows.select("protocol_name", "title", "vote_count", "scores_total", "proposal_created")

    def proposal_date_extreme(self, direction: Any = None) -> DataFrame:
        made = F.col("proposal_created")
        order = made.asc() if one_of("direction", direction, DIRECTIONS) == "ASC" else made.desc()
        return self.now.where(made.isNotNull()).orderBy(order, "proposal_id").limit(5).select("protocol_name", "title", "proposal_created")

    def forum_volume(self) -> DataFrame:
        posts = self.posts.where("is_current").groupBy("protocol_name")
        return posts.agg(F.count("*").alias("posts"), F.count_distinct("topic_id").alias("topics")).orderBy(F.desc("posts"), "protocol_name")

    def list_proposals(self, protocol: Any = None, state: Any = None, since: Any = None, limit: Any = None, offset: Any = None) -> DataFrame:
        rows = self._narrow(protocol, state)
        if (start := day(since)) is not None:
            rows = rows.where(F.col("proposal_created") >= F.lit(start))
        rows = rows.orderBy(F.col("proposal_created").desc_nulls_last(), "proposal_id").offset(whole("offset", offset, 0, 0)).limit(whole("limit", limit, 10, 1, 100))
        return rows.select("proposal_id", "protocol_name", "title", "proposal_state", "proposal_created", "vote_count")

    def get_proposal(self, proposal_id: Any = None) -> DataFrame:
        names = "proposal_id protocol_name title body proposal_state author voting_start voting_end vote_count scores_total proposal_created quorum choices scores discussion_url"
        return self.now.where(F.col("proposal_id") == identifier(proposal_id)).select(*names.split())

    def get_proposal_history(self, proposal_id: Any = None) -> DataFrame:
        rows = self.all.where(F.col("proposal_id") == identifier(proposal_id)).orderBy("valid_from", "record_hash")
        text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        return rows.select("proposal_id", "protocol_name", "title", "proposal_state", "vote_count", "scores_total", "content_hash", text("valid_from"), text("valid_to"), "is_current")
