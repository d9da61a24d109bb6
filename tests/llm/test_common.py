"""Shared pieces: components against a plain search, the shared folder."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import shared
from palimpsest.llm.common import components, cut


def plain(links):
    label = {n: n for link in links for n in link}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    return {n: top(n) for n in label}


def test_components_against_a_plain_search(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(1000 + n, 1001 + n) for n in range(60)] + [(5000, 5001 + n) for n in range(80)] + [(7, 7), (9000, 9000)]
    rng.shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == plain(links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    named = components(spark.createDataFrame([("b", "c"), ("c", "a"), (None, "z")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in named} == {("a", "a"), ("b", "a"), ("c", "a")}


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in found.mkString(" ").split() if "/shuffle_" in f}


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    kept = cut(sums)
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    # What was cut, and the query before it, can still be read; later queries keep their files as before.
    assert kept.count() == sums.count() == 7 and sorted(kept.collect()) == sorted(sums.collect())
    assert spark.conf.get(shared.CLEANUP) == "false" and shuffle_files(spark) - before


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("sc", (), {"getCheckpointDir": staticmethod(lambda: type("o", (), {"isDefined": staticmethod(lambda: False)}))})


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared.shared_dir(Elsewhere)
