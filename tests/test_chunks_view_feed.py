"""Vector chunks, the live view, the feed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.functions import feed
from lumenlog.sources import chunks, loglines
from lumenlog.sources.commits import KeyedTable
from lumenlog.streaming.view import KEYS, SCHEMA, LiveView


def chunk(folder, name, hashes, vectors):
    (folder / f"{name}.f32").write_bytes(np.asarray(vectors, "<f4").tobytes())
    (folder / f"{name}.json").write_text(json.dumps({"hashes": hashes}))


def test_first_hash_wins_and_hashes_need_no_vectors(spark, tmp_path):
    chunk(tmp_path, "a", ["h1", "h2", "h1"], [[1, 2], [3, 4], [9, 9]])
    chunk(tmp_path, "b", ["h2", "h3"], [[8, 8], [5, 6]])
    (tmp_path / "c.json.tmp").write_text("{")
    assert {r["hash"]: list(r["vec"]) for r in chunks.vectors(spark, str(tmp_path), 2).collect()} == {"h1": [1, 2], "h2": [3, 4], "h3": [5, 6]}
    (tmp_path / "a.f32").unlink()
    assert sorted(r["hash"] for r in chunks.hashes(spark, str(tmp_path)).collect()) == ["h1", "h2", "h3"]


def test_a_truncated_chunk_is_an_error(spark, tmp_path):
    chunk(tmp_path, "a", ["h1", "h2"], [[1, 2], [3, 4]])
    (tmp_path / "a.f32").write_bytes(b"\0" * 12)
    with pytest.raises(Exception, match="12 bytes for 2 vectors of 2"):
        chunks.vectors(spark, str(tmp_path), 2).collect()
    assert chunks.hashes(spark, str(tmp_path)).count() == 2


def test_append_round_trip_and_a_failed_write_shows_nothing(spark, tmp_path):
    rows = spark.range(50, numPartitions=3).select(F.col("id").cast("string").alias("hash"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    chunks.append(rows, str(tmp_path / "v"), 2)
    assert {r["hash"]: list(r["vec"]) for r in chunks.vectors(spark, str(tmp_path / "v"), 2).collect()} == {str(i): [i, 0.5] for i in range(50)}
    with pytest.raises(Exception, match="a vector of 2 where 3 are due"):
        chunks.append(rows, str(tmp_path / "w"), 3)
    assert chunks.hashes(spark, str(tmp_path / "w")).count() == 0


def test_the_view_equals_a_batch_read_after_any_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    told = []
    view = LiveView(KeyedTable(spark, str(tmp_path / "view"), KEYS, SCHEMA, buckets=3), lambda event, rows: told.append((event, sorted(r[0].rsplit("/", 1)[1] for r in rows.collect()))))

    def step():
        view.start(loglines.tail(spark, [str(logs)]), str(tmp_path / "ck"), once=True).awaitTermination()
        got = sorted((r["file"], r["offset"], r["n"]) for r in view.snapshot("n long").collect())
        batch = loglines.lines(spark, [str(logs)], pattern="*.jsonl").select("file", "offset", F.from_json("value", "n long")["n"].alias("n"))
        assert got == sorted(map(tuple, batch.collect()))
        return len(got)

    (logs / "a.jsonl").write_text('{"n":1}\n{"n":2}\n')
    (logs / "b.jsonl").write_text('{"n":10}\n{"n":')
    assert step() == 3
    with open(logs / "b.jsonl", "a") as f:
        f.write("11}\n")
    assert step() == 4
    (logs / "a.jsonl").write_text('{"n":7}\n')  # rewritten and shorter: its old lines go
    assert step() == 3
    assert told[-2:] == [("reset", ["a.jsonl"]), ("line", [])]
    before = view.table.snapshot()
    again = spark.createDataFrame([("x", 0, False, "{}")], "file string, offset long, replayed boolean, value string")
    view.put(again, int(before.properties["batch"]))  # a batch that comes again
    assert view.table.snapshot().version == before.version


def test_reasons_halves_and_stops(spark):
    rows = [("disabled", "skip", "off"), ("not-owner-text:agent-completion", "skip", "subagent"), ("not-owner-text:x", "skip", "not-owner"), ("headless:any", "skip", "automated"), ("headless:", "skip", "other"), ("unknown:x", "skip", "unclassified"), ("cap-reached", "capped", "other"), ("new", "skip", "other"), (None, None, None)]
    df = spark.createDataFrame(rows, "reason string, kind string, grp string").withColumn("i", feed.reason_info(F.col("reason")))
    assert all((r["kind"], r["grp"]) == ((r["i"]["kind"], r["i"]["group"]) if r["i"] else (None, None)) for r in df.collect())
    halves = [("prompt", "injected", "x", "info", False, "injected"), ("stop", "blocked", "feedback", "info", True, "blocked"), ("stop", None, "cap-reached", "info", True, "audited"), ("prompt", None, "no-cards", "info", None, "error"), ("prompt", None, None, "error", None, "error"), ("prompt", "ok", None, "info", None, "skip")]
    h = spark.createDataFrame(halves, "event string, outcome string, reason string, level string, audited boolean, kind string")
    assert h.where(feed.half_kind(*map(F.col, ("event", "outcome", "reason", "level", "audited"))) != F.col("kind")).count() == 0
    stops = spark.createDataFrame([(1, "skip", "stop-hook-active"), (2, "skip", None), (3, "audited", None), (4, "audited", None), (5, "error", None)], "at int, kind string, reason string")
    assert stops.agg(feed.shown_stop(F.col("kind"), F.col("reason"), F.col("at"), F.col("at"))).first()[0] == 3
