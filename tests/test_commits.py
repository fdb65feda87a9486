"""Keyed tables: atomic commits, races, crashes, copy-on-write."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lumenlog.sources.commits import Conflict, KeyedTable

SCHEMA = "key string, p double"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["key"], SCHEMA, buckets=4)


def rows(spark, *got):
    return spark.createDataFrame(list(got), SCHEMA)


def held(t, version=None):
    return sorted((r["key"], r["p"]) for r in t.read(version).collect())


def test_insert_or_ignore_replace_and_old_versions(spark, table):
    assert held(table) == []
    assert table.insert_or_ignore(rows(spark, ("a", 0.5), ("b", 0.2), ("b", 0.2))) == 2
    assert table.insert_or_ignore(rows(spark, ("a", 0.9), ("c", None))) == 1
    assert held(table) == [("a", 0.5), ("b", 0.2), ("c", None)]
    assert table.insert_or_ignore(rows(spark, ("a", 0.9))) == 0
    table.replace(rows(spark, ("a", 0.7), ("d", 0.1)), retired=rows(spark, ("b", None)))
    assert held(table) == [("a", 0.7), ("c", None), ("d", 0.1)]
    assert held(table, 1) == [("a", 0.5), ("b", 0.2)]
    table.overwrite(table.read().where("key <> 'c'"))
    assert held(table) == [("a", 0.7), ("d", 0.1)]
    table.append(rows(spark, ("d", 0.3)))
    table.compact()
    assert held(table) == [("a", 0.7), ("d", 0.1), ("d", 0.3)] and all(len(f) == 1 for f in table.snapshot().live.values())
    assert table.vacuum() > 0 and held(table) == [("a", 0.7), ("d", 0.1), ("d", 0.3)]


def test_another_value_is_an_error(spark, table):
    table.insert_or_ignore(rows(spark, ("a", 0.5), ("n", None)), value="p")
    for wrong in (("a", 0.6), ("a", None), ("n", 0.1)):
        with pytest.raises(ValueError, match="another p"):
            table.insert_or_ignore(rows(spark, wrong), value="p")
    assert table.insert_or_ignore(rows(spark, ("a", 0.5), ("n", None), ("z", 1.0)), value="p") == 1


def test_only_touched_buckets_change(spark, table):
    table.append(spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit(0.0).alias("p")))
    before = table.snapshot().live
    changed = table.replace(rows(spark, ("17", 1.0)))
    after = table.snapshot().live
    assert len(changed) == 1 and {b for b in before if before[b] != after[b]} == {str(changed[0])}
    assert table.read().agg(F.sum("p"), F.count("*")).first()[:] == (1.0, 200)


def test_a_crash_between_steps_leaves_the_old_table(spark, table, monkeypatch):
    table.append(rows(spark, ("a", 0.5)))
    monkeypatch.setattr(KeyedTable, "_put", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    for write in (lambda: table.overwrite(rows(spark, ("b", 1.0))), lambda: table.replace(rows(spark, ("a", 1.0))), lambda: table.insert_or_ignore(rows(spark, ("c", 1.0)))):
        with pytest.raises(OSError, match="crash"):
            write()
        assert held(table) == [("a", 0.5)]
    monkeypatch.undo()
    assert table.vacuum() == 3 and held(table) == [("a", 0.5)]


def test_a_lost_race_is_tried_again(spark, table):
    table.append(rows(spark, ("a", 0.5)))
    base = table.snapshot()
    table.append(rows(spark, ("b", 0.5)))
    with pytest.raises(Conflict):
        table._put(base, {}, {})
    assert held(table) == [("a", 0.5), ("b", 0.5)]


def test_writers_at_once_lose_no_row(spark, table):
    def write(i):
        try:
            table.insert_or_ignore(rows(spark, *[(f"{i}-{j}", float(j)) for j in range(5)], ("same", 1.0)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    failed = []
    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert held(table) == sorted([(f"{i}-{j}", float(j)) for i in range(4) for j in range(5)] + [("same", 1.0)])
    assert not [f for f in os.listdir(f"{table.path}/manifest") if f.endswith(".tmp")]
