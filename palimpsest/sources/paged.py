"""Paged remote sources as Spark data sources: a rate limit, retries, cursors and pages, one partition for each space.

The transport is a picklable callable ``(method, url, params) -> (status, headers, body)``, so that tests and offline
runs bring their own; nothing here opens a connection by itself.
"""

from __future__ import annotations

import base64
import json
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from palimpsest.shared import scratch
from palimpsest.shipping import ship

Transport = Callable[[str, str, dict[str, Any]], tuple[int, dict[str, str], Any]]


class SourceError(RuntimeError):
    """A remote answer that no retry mends."""


class RateLimit:
    """A token bucket: bursts of a sixth of a minute's calls, refilled steadily. Clock and sleep can be injected."""

    def __init__(self, per_minute: float, burst: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_minute <= 0:
            raise ValueError("the rate must be positive")
        self.per_second, self.burst = per_minute / 60, burst or max(1, int(per_minute // 6))
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.held, self.last = float(self.burst), clock()

    def acquire(self, n: float = 1.0) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.held = min(self.burst, self.held + max(0.0, now - self.last) * self.per_second)
                self.last = now
                if self.held >= n:
                    self.held -= n
                    return
                wait = (n - self.held) / self.per_second
            self.sleep(wait)


#: Answers worth another try, and the longest wait between two.
AGAIN, LONGEST = frozenset({429, 500, 502, 503, 504}), 60.0


def request(transport: Transport, method: str, url: str, params: dict[str, Any], limit: RateLimit | None = None, attempts: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Any:
    """The body of a successful call. 429, 5xx and transport errors are tried again, after Retry-After (seconds; a date
    counts as none) or twice as long each time with up to a tenth more, a minute at most; other answers fail at once."""
    for n in range(attempts):
        if limit:
            limit.acquire()
        wait = min(base * 2**n, LONGEST) * (1 + 0.1 * jitter())
        try:
            status, headers, body = transport(method, url, params)
        except OSError as e:
            problem: Exception = e
        else:
            if status < 400:
                return body
            problem = SourceError(f"{method} {url}: {status}")
            if status not in AGAIN:
                raise problem
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            try:
                wait = min(float(after), LONGEST) if after else wait
            except ValueError:
                pass
        if n + 1 < attempts:
            sleep(wait)
    raise SourceError(f"{method} {url}: gave up after {attempts} attempts") from problem


def cursor_pages(fetch: Callable[[int, int | None], list[dict]], limit: int = 100, page: int = 50) -> Iterator[dict]:
    """Objects newest first: ``fetch(count, created_before)``. Ends at the limit, a short page or a cursor that stalls."""
    seen: set[str] = set()
    before, n = None, 0
    while n < limit:
        want = min(page, limit - n)
        batch = fetch(want, before)
        for item in batch:
            if item["id"] not in seen and n < limit:
                seen.add(item["id"])
                n += 1
                yield item
        oldest = min((item["created"] for item in batch), default=None)
        if len(batch) < want or oldest is None or (before is not None and oldest >= before):
            return
        before = oldest


def numbered_pages(fetch: Callable[[int], list[dict]], limit: int = 30, most: int = 10) -> Iterator[dict]:
    """Objects of pages 0, 1 ..: ends at the limit, after ``most`` pages, or at a page with nothing new."""
    seen: set[Any] = set()
    for number in range(most):
        fresh = [item for item in fetch(number) if item["id"] not in seen] if len(seen) < limit else []
        if not fresh:
            return
        for item in fresh:
            if len(seen) < limit and item["id"] not in seen:
                seen.add(item["id"])
                yield item


def graph_query(call: Callable[[dict[str, Any]], dict], query: str, variables: dict[str, Any]) -> dict:
    """The data of a GraphQL answer; errors in an otherwise good answer are raised."""
    answer = call({"query": query, "variables": variables})
    if answer.get("errors"):
        raise SourceError(f"the query failed: {answer['errors']}")
    return answer.get("data") or {}


# Where proposals are asked for, and the queries in the API's language.
PROPOSALS_URL = "https://hub.snapshot.org/graphql"
PROPOSALS_QUERY = """
query Proposals($space: String!, $first: Int!, $createdLt: Int) {
  proposals(first: $first, where: {space: $space, created_lt: $createdLt}, orderBy: "created", orderDirection: desc) {
    id ipfs title body discussion state type start end created author quorum scores scores_total votes choices link
    space { id name }
  }
}
"""
SPACE_QUERY = "query Space($id: String!) { space(id: $id) { id name about network symbol proposalsCount followersCount } }"


@dataclass
class ProposalClient:
    """Proposals by space from a GraphQL API. One limiter for each client, made where the client is used."""

    transport: Transport
    per_minute: float = 60.0
    url: str = PROPOSALS_URL
    sleep: Callable[[float], None] = time.sleep
    limit: RateLimit = field(init=False)

    def __post_init__(self) -> None:
        self.limit = RateLimit(self.per_minute, sleep=self.sleep)

    def ask(self, query: str, variables: dict[str, Any]) -> dict:
        return graph_query(lambda body: request(self.transport, "POST", self.url, body, self.limit, sleep=self.sleep), query, variables)

    def space(self, name: str) -> dict | None:
        """A space's metadata, null for an unknown one."""
        return self.ask(SPACE_QUERY, {"id": name}).get("space")

    def proposals(self, space: str, limit: int = 100, page: int = 50) -> Iterator[dict]:
        """The newest proposals of a space."""
        fetch = lambda n, before: self.ask(PROPOSALS_QUERY, {"space": space, "first": n, "createdLt": before}).get("proposals") or []
        return cursor_pages(fetch, limit, page)


@dataclass
class ForumClient:
    """Topics of a forum from its REST API."""

    host: str
    transport: Transport
    per_minute: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    limit: RateLimit = field(init=False)

    def __post_init__(self) -> None:
        self.host = re.sub(r"^https?://|/+$", "", self.host)
        self.limit = RateLimit(self.per_minute, sleep=self.sleep)

    def get(self, path: str, params: dict[str, Any] | None = None) -> dict:
        return request(self.transport, "GET", f"https://{self.host}/{path}", params or {}, self.limit, sleep=self.sleep)

    def latest(self, page: int = 0) -> list[dict]:
        """A page of the listing: topics without posts."""
        return (self.get("latest.json", {"page": page}).get("topic_list") or {}).get("topics") or []

    def topic(self, id: int) -> dict:
        """A topic with its first posts."""
        return self.get(f"t/{id}.json")

    def topics(self, limit: int = 30, most: int = 10) -> Iterator[dict]:
        return numbered_pages(self.latest, limit, most)

    def with_posts(self, limit: int = 30, most: int = 10) -> Iterator[dict]:
        """Listed topics, each looked up: the listing has no posts."""
        return (self.topic(t["id"]) for t in self.topics(limit, most))


def sql_pages(spark: SparkSession, statement: str, page: int = 10_000, **values: Any) -> Iterator[list[dict[str, Any]]]:
    """A statement's rows as dictionaries, a page at a time; ``values`` fill its ``:names``.

    Executors write the result in files of a page each, and the driver reads one of them at a time, so results of any size
    pass through bounded memory and nothing is worked out twice. An order the statement asks for is kept.
    """
    rows = spark.sql(statement, args=values or None)
    folder = f"{scratch(spark, 'pages')}/rows"
    rows.write.option("maxRecordsPerFile", page).parquet(folder)
    whole = spark.read.schema(rows.schema).parquet(folder)
    for path in sorted(whole.inputFiles()):
        if found := [r.asDict(recursive=True) for r in spark.read.schema(rows.schema).parquet(path).collect()]:
            yield found


def sql_rows(spark: SparkSession, statement: str, **values: Any) -> list[dict[str, Any]]:
    """All of a statement's rows as dictionaries, for results that a client holds anyway (see ``sql_pages``)."""
    return [r for rows in sql_pages(spark, statement, **values) for r in rows]


OBJECTS = "space_key string, id string, payload string"


def proposal_objects(transport: Transport, limit: int = 100, per_minute: float = 60.0) -> Callable[[str], Iterator[dict]]:
    """What ``read_paged`` takes to fetch a space's proposals as JSON text. Each partition has a limiter of its own."""

    def fetch(space: str) -> Iterator[dict]:
        for one in ProposalClient(transport, per_minute).proposals(space, limit):
            yield {"id": one["id"], "payload": json.dumps(one, sort_keys=True, ensure_ascii=False)}

    return fetch


def topic_objects(transport: Transport, limit: int = 30, per_minute: float = 60.0, most: int = 10) -> Callable[[str], Iterator[dict]]:
    """The same for a forum's topics with their posts."""

    def fetch(host: str) -> Iterator[dict]:
        for one in ForumClient(host, transport, per_minute).with_posts(limit, most):
            yield {"id": str(one["id"]), "payload": json.dumps(one, sort_keys=True, ensure_ascii=False)}

    return fetch


def with_details(topics: DataFrame, transport: Transport, host: str = "forum_host", id: str = "topic_id", per_minute: float = 60.0) -> DataFrame:
    """Listed topics with payload string, each one's detail; a limiter for each host in each task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, ForumClient] = {}
        for pdf in frames:
            found = []
            for h, i in zip(pdf[host], pdf[id], strict=True):
                client = clients.setdefault(h, ForumClient(h, transport, per_minute))
                found.append(json.dumps(client.topic(int(i)), sort_keys=True, ensure_ascii=False))
            yield pdf.assign(payload=found)

    ship(topics.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in topics.dtypes)
    return topics.repartition(host).mapInPandas(work, f"{kinds}, payload string")


@dataclass
class ProposalFeed:
    """What ``stream_paged`` takes to follow the proposals of spaces by when they were made."""

    transport: Transport
    per_minute: float = 60.0
    page: int = 50
    sleep: Callable[[float], None] = time.sleep

    def _page(self, space: str) -> Callable[[int, int | None], list[dict]]:
        client = ProposalClient(self.transport, self.per_minute, sleep=self.sleep)
        return lambda n, before: client.ask(PROPOSALS_QUERY, {"space": space, "first": n, "createdLt": before}).get("proposals") or []

    def newest(self, space: str) -> int | None:
        """The time of the space's newest proposal, null if it has none."""
        return next((item["created"] for item in self._page(space)(1, None)), None)

    def between(self, space: str, after: int | None, upto: int) -> Iterator[dict]:
        """Proposals made after one time and not after another, as objects: the same whenever it is asked."""
        for one in between_pages(self._page(space), after, upto, self.page):
            yield {"id": one["id"], "created": one["created"], "payload": json.dumps(one, sort_keys=True, ensure_ascii=False)}


def between_pages(fetch: Callable[[int, int | None], list[dict]], after: int | None, upto: int, page: int = 50) -> Iterator[dict]:
    """Objects newest first, made in (after, upto]. A page begins again at the time where the last one ended, as others
    of that time may have been cut off; a page that is all of one time is asked for anew at twice the size."""
    seen: set[str] = set()
    before, size = upto + 1, page
    while True:
        batch = fetch(size, before)
        for item in batch:
            if after is not None and item["created"] <= after:
                return
            if item["id"] not in seen:
                seen.add(item["id"])
                yield item
        if len(batch) < size:
            return
        oldest = min(item["created"] for item in batch)
        if oldest + 1 < before:
            before, size = oldest + 1, page
        else:
            size *= 2


class Range(InputPartition):
    """A space, after a time (null: from the first) and up to another."""

    def __init__(self, name: str, after: int | None, upto: int):
        self.name, self.after, self.upto = name, after, upto


class PagedStreamReader(DataSourceStreamReader):
    """An offset is the time up to which each space has been read. Ends are fixed before anything is read and logged in
    the checkpoint, so a batch that is run again asks for the same ranges."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.spaces = schema.names, [s for s in options["spaces"].split(",") if s]
        self.feed = cloudpickle.loads(base64.b64decode(options["feed"]))
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for space in self.spaces:
            newest = self.feed.newest(space)
            if newest is not None:
                self.last[space] = max(newest, self.last.get(space, newest))
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # A space that a restart finds without an answer keeps its place.
        self.last = {**start, **end}
        return [Range(s, start.get(s), upto) for s, upto in sorted(end.items()) if start.get(s) != upto]

    def read(self, partition: Range) -> Iterator[tuple]:
        for item in self.feed.between(partition.name, partition.after, partition.upto):
            yield tuple(partition.name if n == "space_key" else item.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        pass


class Space(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[Space]:
        return [Space(s) for s in self.options["spaces"].split(",") if s]

    def read(self, partition: Space) -> Iterator[tuple]:
        fetch = cloudpickle.loads(base64.b64decode(self.options["fetch"]))
        for item in fetch(partition.name):
            yield tuple(partition.name if n == "space_key" else item.get(n) for n in self.names)


class PagedSource(DataSource):
    """Format ``paged``: options ``spaces`` (by comma) and ``fetch``, a pickled callable from a space to its objects; for
    a stream ``feed``, a pickled object with ``newest`` and ``between`` (see ``ProposalFeed``)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "space_key string, id string, title string, created bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return PagedStreamReader(schema, dict(self.options))


def read_paged(spark: SparkSession, spaces: list[str], fetch: Callable[[str], Iterator[dict]], schema: StructType | str | None = None):
    """Objects of every space as rows, one partition each; ``fetch`` runs on the workers."""
    ship(spark)
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("spaces", ",".join(spaces)).option("fetch", base64.b64encode(cloudpickle.dumps(fetch)).decode())
    return (reader.schema(schema) if schema is not None else reader).load()


def stream_paged(spark: SparkSession, spaces: list[str], feed: Any, schema: StructType | str = f"{OBJECTS}, created bigint") -> DataFrame:
    """What each space has had since the last batch, as a stream; ``feed`` runs on the workers and, for the offsets, on
    the driver. A stream that stops goes on where its checkpoint says, without loss or repeats. Objects that appear
    later under a time already passed are not seen: a feed whose times may lag must give a ``newest`` that lags, too."""
    ship(spark)
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").option("spaces", ",".join(spaces)).option("feed", base64.b64encode(cloudpickle.dumps(feed)).decode()).schema(schema).load()
