"""Paged sources as streams: ranges by time, replayed exactly."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from palimpsest.sources import paged
from palimpsest.streaming.observations import to_files

SCHEMA = f"{paged.OBJECTS}, created bigint"


class Api:
    """Proposals from a file, so that they can appear while a stream is stopped; may fail once after some calls."""

    def __init__(self, path, fail_at=None):
        self.path, self.fail_at = str(path), fail_at

    def __call__(self, method, url, params):
        v = params["variables"]
        with open(self.path) as f:
            rows = [r for r in json.load(f) if r["space"] == v["space"] and (v["createdLt"] is None or r["created"] < v["createdLt"])]
        if self.fail_at is not None and v["createdLt"] is not None and v["createdLt"] <= self.fail_at and not os.path.exists(f"{self.path}.failed"):
            open(f"{self.path}.failed", "w").close()
            return 400, {}, None
        return 200, {}, {"data": {"proposals": sorted(rows, key=lambda r: (-r["created"], r["id"]))[: v["first"]]}}


def put(path, rows):
    with open(path, "w") as f:
        json.dump([{"id": i, "space": s, "created": c} for i, s, c in rows], f)


def follow(spark, tmp_path, api, spaces=("a", "b", "none")):
    feed = paged.ProposalFeed(api, 1e9, page=3, sleep=lambda _: None)
    to_files(paged.stream_paged(spark, list(spaces), feed), f"{tmp_path}/out", f"{tmp_path}/check")
    return sorted((r.id, r.space_key, r.created) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())


def test_pages_between_times():
    rows = [{"id": n, "created": n // 4} for n in range(40)]  # four at each time
    calls = []

    def fetch(n, before):
        calls.append((n, before))
        return sorted((r for r in rows if r["created"] < before), key=lambda r: (-r["created"], r["id"]))[:n]

    for page in (1, 3, 4, 7, 100):
        assert sorted(r["id"] for r in paged.between_pages(fetch, 2, 7, page)) == list(range(12, 32))
    assert sorted(r["id"] for r in paged.between_pages(fetch, None, 1, 3)) == list(range(8))
    assert list(paged.between_pages(lambda n, b: [], None, 5)) == []


def test_stops_and_resumes_without_loss_or_repeats(spark, tmp_path):
    first = [(f"p{n}", "ab"[n % 2], 10 + n // 3) for n in range(30)]
    put(tmp_path / "api", first)
    assert follow(spark, tmp_path, Api(tmp_path / "api")) == sorted(first)
    assert follow(spark, tmp_path, Api(tmp_path / "api")) == sorted(first)  # nothing new
    more = first + [(f"q{n}", "ab"[n % 2], 21 + n) for n in range(9)] + [("only", "none", 5)]
    put(tmp_path / "api", more)
    assert follow(spark, tmp_path, Api(tmp_path / "api")) == sorted(more)


def test_a_batch_that_failed_is_replayed_with_its_own_ends(spark, tmp_path):
    rows = [(f"p{n}", "ab"[n % 2], 100 + n) for n in range(40)]
    put(tmp_path / "api", rows)
    with pytest.raises(StreamingQueryException):
        follow(spark, tmp_path, Api(tmp_path / "api", fail_at=120))
    # More appears before the restart: the failed batch still ends where it was to end, and a later one takes the rest.
    put(tmp_path / "api", rows + [("late", "a", 500)])
    assert sorted(rows) == [r for r in follow(spark, tmp_path, Api(tmp_path / "api", fail_at=120)) if r[0] != "late"]
    assert follow(spark, tmp_path, Api(tmp_path / "api", fail_at=120)) == sorted(rows + [("late", "a", 500)])
    logged = sorted(p for p in os.listdir(f"{tmp_path}/check/offsets") if p.isdigit())
    with open(f"{tmp_path}/check/offsets/{logged[0]}") as f:
        assert "500" not in f.read()
