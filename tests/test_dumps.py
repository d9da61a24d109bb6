"""Dumps over many splits, and copies of objects that can be taken up again."""

import gzip
import os

import pytest

from palimpsest.sources import objects


def dump():
    """(text, rows of ``public.t``): two blocks of other tables, one of t whose rows look like heads and ends, another of t."""
    rows = [(n, f"row {n} \\ \t\n{'x' * (n % 40)}" if n % 5 else None) for n in range(300)]

    def shown(v):
        return "\\N" if v is None else v.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")

    one = "".join(f"{n}\t{shown(t)}\n" for n, t in rows)
    tricky = [(900, "COPY public.t (a, b) FROM stdin;"), (901, "\\.x")]
    head = "COPY public.t (a, b) FROM stdin;\n"
    text = "-- dump\nSET x = 1;\n\\.\n" + "COPY public.other (a, b) FROM stdin;\n" + "".join(f"{n}\tno\n" for n in range(80)) + "COPY public.t (a, b) FROM stdin;\n\\.\n\n"
    text += head + one + "".join(f"{n}\t{shown(t)}\n" for n, t in tricky) + "\\.\nCOPY x (a) FROM stdin;\n1\n\\.\n" + head + "7\tagain\n\\.\n"
    return text, rows + tricky + [(7, "again")]


@pytest.fixture
def splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path, table="t"):
    return sorted(map(tuple, objects.read_copy(spark, path, "a int, b string", table).collect()))


def test_one_dump_over_many_splits(spark, tmp_path, splits):
    text, rows = dump()
    with open(tmp_path / "d.sql", "w") as f:
        f.write(text)
    found = objects.read_copy(spark, f"{tmp_path}/d.sql", "a int, b string", "public.t")
    assert found.rdd.getNumPartitions() > 50 and "Coalesce" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


def test_the_first_block_and_missing_ones(spark, tmp_path, splits):
    text, _ = dump()
    with open(tmp_path / "d.sql", "w") as f:
        f.write(text.replace("COPY public.t (a, b) FROM stdin;\n\\.\n\n", "\\.\n", 1))
    assert read(spark, f"{tmp_path}/d.sql", None) == [(n, "no") for n in range(80)]
    assert read(spark, f"{tmp_path}/d.sql", "nobody") == []
    (tmp_path / "e.sql").write_text("-- nothing\n")
    assert read(spark, f"{tmp_path}/e.sql") == []


def test_files_in_order_and_gzip(spark, tmp_path):
    text, rows = dump()
    half = len(text) // 2
    cut = text.rindex("\n", 0, half) + 1
    (tmp_path / "in").mkdir()
    for name, part in (("a.sql.gz", text[:cut]), ("b.sql.gz", text[cut:])):
        with gzip.open(tmp_path / "in" / name, "wt") as f:
            f.write(part)
    assert sorted(map(tuple, objects.read_copy(spark, f"{tmp_path}/in", "a int, b string", "t").collect()), key=str) == sorted(rows, key=str)


def test_restore_takes_up_where_it_was_lost(spark, tmp_path):
    for n in range(40):
        place = tmp_path / "a" / f"space={n % 3}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{n}.json").write_text('{"n": %d}' % n + " " * n)
    (tmp_path / "a" / "other.txt").write_text("x")
    # A folder in the place of one object makes its copy fail, as a lost task would leave it undone.
    os.makedirs(tmp_path / "b" / "space=0" / "0.json" / "x")
    (tmp_path / "b" / "space=1").mkdir()
    (tmp_path / "b" / "space=1" / "1.json").write_text("torn")
    (tmp_path / "b" / "space=2").mkdir()
    (tmp_path / "b" / "space=2" / "2.json").write_text('{"n": 2}  ')
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert objects.restore(spark, a, b) == {"copied": 38, "skipped": 1, "errors": 1}
    os.removedirs(tmp_path / "b" / "space=0" / "0.json" / "x")
    os.makedirs(tmp_path / "b" / "space=0", exist_ok=True)
    (tmp_path / "a" / "space=0" / "new.json").write_text("{}")
    assert objects.restore(spark, a, b) == {"copied": 2, "skipped": 39, "errors": 0}
    assert objects.restore(spark, a, b) == {"copied": 0, "skipped": 41, "errors": 0}
    for n in range(40):
        place = f"space={n % 3}/{n}.json"
        assert (tmp_path / "a" / place).read_text() == (tmp_path / "b" / place).read_text()
    assert not (tmp_path / "b" / "other.txt").exists()
    assert {r.n for r in spark.read.schema("n int").option("recursiveFileLookup", "true").json(b).collect()} >= set(range(40))
