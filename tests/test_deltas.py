"""Tables with deltas against a dictionary, and what a run writes."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from forumlens.functions.keyed import arrival
from forumlens.sources import deltas
from forumlens.sources.deltas import Conflict, KeyedTable
from forumlens.sources.tables import write_version
from tests.fixture import values

SCHEMA = "id string, value long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True))


@pytest.mark.parametrize("mode", ["update", "ignore"])
def test_table_follows_a_dictionary(spark, tmp_path, mode):
    rng = random.Random(4)
    table, held, loose = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=3), {}, []
    for step in range(6):
        some = [(f"k{rng.randrange(12)}", step * 100 + i) for i in range(rng.randrange(1, 9))] + [(None, step)] * (step % 3)
        state = table.upsert(frame(spark, some), mode=mode, order=[F.desc("value") if mode == "update" else F.asc("value")], count=True)
        for key, value in some:
            if key is None:
                loose.append((key, value))
            elif mode == "update":
                held[key] = value
            else:
                held.setdefault(key, value)
        wanted = sorted([*held.items(), *loose], key=repr)
        assert rows(table.read()) == wanted and state.rows == len(wanted) and state.number >= step + 1
        if step in (2, 4):
            before = table.state()
            assert table.compact(0) and rows(table.read()) == wanted and rows(table.read(before)) == wanted
            assert all(p.base for p in table.state().parts) and table.compact(0) == []
    table.vacuum()
    assert rows(table.read()) == wanted


def test_a_small_run_writes_little(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    text = F.concat_ws("-", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(4)])
    whole = spark.range(40_000).select(F.format_string("k%06d", "id").alias("id"), text.alias("value"))
    table.upsert(whole)
    first = size(table.path)
    few = whole.filter(F.xxhash64("id") % 100 == 0).withColumn("value", F.reverse("value"))
    touched = few.count()
    assert 250 < touched < 550
    table.upsert(few, "run-1")
    assert size(table.path) - first < first / 10
    now = table.read()
    assert now.count() == 40_000 and now.join(few, ["id", "value"]).count() == touched
    # A repeat changes nothing; one bucket that grows beyond the ratio is rewritten alone.
    state, held = table.state(), size(table.path)
    assert table.upsert(few, "run-1") == state and table.compact() == [] and size(table.path) == held
    own = whole.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == 2)
    table.upsert(own, "run-2")
    assert table.compact() == [2]
    assert size(table.path) - held < 0.7 * first and table.read().count() == 40_000


def test_a_run_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    table.upsert(frame(spark, [("a", 1), ("b", 2)]), "one")
    bad = frame(spark, [("a", 3)]).withColumn("value", F.raise_error(F.lit("no")).cast("long"))
    for action in (lambda: table.upsert(bad, "two"), lambda: table.replace(bad, "two")):
        with pytest.raises(Exception, match="no"):
            action()
        assert rows(table.read()) == [("a", 1), ("b", 2)]
    # Written, but killed in front of its commit.
    kept = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, state: (_ for _ in ()).throw(KeyboardInterrupt))
    for action in (lambda: table.upsert(frame(spark, [("a", 3)]), "two"), lambda: table.replace(frame(spark, [("c", 3)]), "two")):
        with pytest.raises(KeyboardInterrupt):
            action()
    monkeypatch.setattr(KeyedTable, "_commit", kept)
    assert rows(table.read()) == [("a", 1), ("b", 2)]
    table.upsert(frame(spark, [("a", 3)]), "two")
    table.upsert(frame(spark, [("a", 3)]), "two")
    assert rows(table.read()) == [("a", 3), ("b", 2)] and table.state().number == 2
    assert len(table.vacuum()) >= 2 and rows(table.read()) == [("a", 3), ("b", 2)]


def test_two_runs_and_a_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table, other = (KeyedTable(spark, path, "id", buckets=2) for _ in range(2))
    table.upsert(frame(spark, [(f"k{i}", i) for i in range(20)]))
    table.upsert(frame(spark, [("k1", 100)]))
    written = KeyedTable._write

    def beside(action):
        """Run an action after the next write, before its commit."""
        def run(self, *args):
            parts = written(self, *args)
            monkeypatch.setattr(KeyedTable, "_write", written)
            action()
            return parts

        monkeypatch.setattr(KeyedTable, "_write", run)

    beside(lambda: other.upsert(frame(spark, [("k2", 200)])))
    with pytest.raises(Conflict):
        table.upsert(frame(spark, [("k3", 300)]))
    beside(lambda: other.compact(0))
    table.upsert(frame(spark, [("k3", 300)]))
    beside(lambda: other.upsert(frame(spark, [("k4", 400)])))
    table.compact(0)
    beside(lambda: other.replace(table.read().filter("id < 'k5'")))
    with pytest.raises(Conflict):
        table.compact(0)
    values = {f"k{i}": i for i in range(20)} | {"k1": 100, "k2": 200, "k3": 300, "k4": 400}
    assert rows(table.read()) == sorted((k, v) for k, v in values.items() if k < "k5")


def test_new_columns_old_tables_and_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "id", buckets=2, partition_by=["kind"])
    assert table.read() is None and table.compact() == []
    with_kind = "id string, kind string"
    table.upsert(spark.createDataFrame([], with_kind))
    assert table.read().columns == ["id", "kind"] and table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", "x"), ("b", "y")], with_kind))
    table.upsert(spark.createDataFrame([("b", "x", 1)], with_kind + ", n int"))
    assert rows(table.read()) == [("a", "x", None), ("b", "x", 1)]
    assert rows(table.read().filter("kind = 'x'").select("id")) == [("a",), ("b",)] and rows(table.read(columns=["n"])) == [(1,), (None,)]
    table.replace(spark.createDataFrame([("c", "z")], with_kind))
    assert rows(table.read()) == [("c", "z")]
    old = str(tmp_path / "old")
    write_version(frame(spark, [("a", 1), ("b", 2)]), old)
    table = KeyedTable(spark, old, "id")
    table.upsert(frame(spark, [("b", 3)]), order=arrival(frame(spark, [])))
    assert rows(table.read()) == [("a", 1), ("b", 3)]


def test_commits_remember_runs_within_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deltas, "RUNS_KEPT", 2)
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=1)
    for run in ("a", "b", "c"):
        table.upsert(frame(spark, [(run, 1)]), run)
    assert table.state().runs == ("b", "c")


def test_rows_that_were_not_there_are_added_without_a_join(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    made = lambda *rows: spark.createDataFrame(list(rows), "id string, n int")
    table.replace(made(("a", 1), (None, 0)))
    table.upsert(made(("a", 2), ("b", 2), (None, 2)), mode="ignore")
    table.upsert(made(("b", 3), ("c", 3)), mode="ignore")
    held = [(None, 0), (None, 2), ("a", 1), ("b", 2), ("c", 3)]
    by_id = lambda frame: sorted(values(frame, "id", "n"), key=str)
    assert by_id(table.read()) == sorted(held, key=str)
    assert "Join" not in table.read()._jdf.queryExecution().optimizedPlan().toString()
    # What is replaced later is, and what comes after that is added again.
    table.upsert(made(("b", 4), ("d", 4)))
    table.upsert(made(("d", 5), ("e", 5)), mode="ignore")
    held = [(None, 0), (None, 2), ("a", 1), ("b", 4), ("c", 3), ("d", 4), ("e", 5)]
    assert by_id(table.read()) == sorted(held, key=str)
    table.compact(0.0)
    assert by_id(table.read()) == sorted(held, key=str)
    table.upsert(made(("a", 6), ("f", 6)), mode="ignore")
    assert by_id(table.read()) == sorted([*held, ("f", 6)], key=str)


def test_one_delta_is_not_ranked_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    for n in (1, 2):
        table.upsert(spark.createDataFrame([("a", n), (None, n)], "id string, n int"))
    assert sorted(values(table.read(), "id", "n"), key=str) == sorted([("a", 2), (None, 1), (None, 2)], key=str)
    assert "Window" not in table.read()._jdf.queryExecution().optimizedPlan().toString()
    table.upsert(spark.createDataFrame([("a", 3)], "id string, n int"))
    assert sorted(values(table.read(), "id", "n"), key=str) == sorted([("a", 3), (None, 1), (None, 2)], key=str)
