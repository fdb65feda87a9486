"""State with timers against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import selection, temporal
from lumenlog.streaming import state

START = datetime.datetime(2024, 1, 1)
DAY = 86_400_000_000


@pytest.fixture(autouse=True)
def rocksdb(spark):
    state.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def passes(spark, tmp_path, stream, schema, files):
    """What the stream gives out over files that come one after another, restarted before each."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_hubs_equal_the_batch_at_any_instant(spark, tmp_path):
    rng = random.Random(1)
    told = sorted((START + datetime.timedelta(hours=rng.uniform(0, 24 * 40)), rng.randrange(4), rng.randrange(6)) for _ in range(120))
    told.append((START + datetime.timedelta(days=90), 99, 99))  # moves the watermark past all others
    files, rows = [told[:40], told[40:80], told[80:120], told[120:]], told
    changes = passes(spark, tmp_path, lambda s: state.hub_changes(s, 14, "10 minutes"), "ts timestamp, id long, session long", files).cache()
    history = spark.createDataFrame(rows, "ts timestamp, id long, session long").withColumn("micros", F.unix_micros("ts")).cache()
    first = history.agg(F.min("micros")).first()[0]
    instants = [first + int(rng.uniform(0, 60) * DAY) for _ in range(6)] + [r["micros"] for r in history.orderBy("micros").limit(3).collect()] + [first + 14 * DAY]
    for now in instants:
        for session in (None, 2):
            batch = sorted(map(tuple, selection.hub_ids(history.where("id <> 99"), now, 14, 2, session).collect()))
            assert sorted(map(tuple, state.hubs_at(changes.where("id <> 99"), now, 2, session).collect())) == batch


def test_runs_persist_between_passes(spark, tmp_path):
    rng = random.Random(2)
    minute = datetime.timedelta(minutes=1)
    rows, at = [], START
    for i in range(90):
        at += minute * rng.choice([1, 5, 20, 45, 90])
        rows.append((at, rng.randrange(3), i, rng.choice(["/auto", "/help", None, None, None, None]), rng.random() < 0.1))
    end = [(at + minute * 10_000, 99, 1000, None, False)]
    schema = "ts timestamp, session_id long, at long, command string, image boolean"
    got = passes(spark, tmp_path, lambda s: state.run_stream(s, temporal.RUN_IDLE), schema, [rows[:30], rows[30:31], rows[31:], end])
    batch = temporal.auto_runs(spark.createDataFrame(rows, schema).withColumn("micros", F.unix_micros("ts")))
    assert sorted(map(tuple, got.where("session_id <> 99").collect())) == sorted(map(tuple, batch.collect()))
    assert got.where("submission").count() > 0
