"""Rules that no query runs: card rows, sessions, history, repos, hub windows, temp projects."""

import datetime

from pyspark.sql import functions as F

from lumenlog.operators import eligibility
from lumenlog.sources import tables, transcripts
from lumenlog.streaming import live


def test_card_problems(spark):
    rows = [
        ("a", "rule", "global", None, "one two"), ("", "rule", "global", None, "x"), (None, "rule", "global", None, "x"), ("b", "odd", "global", None, "x"), ("c", None, "repo", "r", "x"), ("d", "rule", "odd", None, "x"),
        ("e", "rule", "global", "r", "x"), ("f", "rule", "repo", None, "  \n "), ("g", "rule", "repo", None, None), ("h", "rule", "repo", None, "w " * 4), ("i", "rule", "repo", None, " w \n w\tw "),
    ]
    df = spark.createDataFrame(rows, "id string, kind string, scope string, scope_repo string, gist string").withColumn("i", F.monotonically_increasing_id())
    got = [list(r[0]) for r in df.orderBy("i").select(eligibility.card_problems(("rule",), ("global", "repo"), 3)).collect()]
    assert got == [[], ["id is missing"], ["id is missing"], ["kind is unknown"], ["kind is unknown"], ["scope is unknown"], ["a global card names a repo"], ["gist is empty"], ["gist is empty"], ["gist is too long"], []]


def test_rows_of_interactive_sessions(spark):
    rows = spark.createDataFrame([("f", 1), ("g", 1), ("h", 1)], "file string, line_no int")
    verdicts = spark.createDataFrame([("f", "interactive"), ("f", "interactive"), ("g", "exec")], "file string, verdict string")
    assert [r["file"] for r in transcripts.of_sessions(rows, verdicts).collect()] == ["f"]
    assert [r["file"] for r in transcripts.of_sessions(rows, verdicts, "exec").collect()] == ["g"]


def test_history_that_no_transcript_holds(spark):
    typed = spark.createDataFrame([("s1", "p", "in a rollout"), ("s2", "p", "held  text"), ("s2", "q", "held text"), (None, "p", "no session"), ("s3", "p", None)], "session_id string, project string, raw string")
    rollouts = spark.createDataFrame([("s1",), ("s1",)], "session_id string")
    turns = spark.createDataFrame([("p", "held text"), ("p", "held\ttext ")], "project string, raw string")
    assert sorted((r["session_id"] or "", r["project"]) for r in transcripts.history_without_transcripts(typed, rollouts, turns).collect()) == [("", "p"), ("s2", "q"), ("s3", "p")]
    goals = typed.withColumn("command", F.when(F.col("session_id") == "s1", "/auto"))
    kept = transcripts.history_without_transcripts(goals, rollouts, turns, F.col("command") == "/auto")
    assert sorted(r["session_id"] or "" for r in kept.collect()) == ["", "s1", "s2", "s3"] and "in_rollout" not in kept.columns


def test_of_known_copies_the_first_listed_is_kept(spark):
    files = spark.createDataFrame([("h", "/h/sessions/a/r.jsonl", 9), ("h", "/h/sessions/b/r.jsonl", 5), ("h", "/h/archived_sessions/r.jsonl", 7)], "home string, file string, size long")
    kept = lambda *known: [r["file"] for r in transcripts.rollout_copies(files, spark.createDataFrame(list(known), "file string, nth int")).where("kept").collect()]
    assert kept() == ["/h/sessions/a/r.jsonl"]
    assert kept(("/h/sessions/b/r.jsonl", 1), ("/h/sessions/a/r.jsonl", 2)) == ["/h/sessions/b/r.jsonl"]
    assert kept(("/h/archived_sessions/r.jsonl", 3), ("/x", 1)) == ["/h/archived_sessions/r.jsonl"]


def test_repaired_repos(spark):
    s = spark.createDataFrame([(1, "f", None), (2, "f", "own"), (3, "g", None)], "id int, file string, repo string")
    cwds = spark.createDataFrame([("f", "/home/me/work/thing")], "file string, cwd string")
    got = tables.repaired_repos(s, cwds, lambda c: F.element_at(F.split(c, "/"), -1))
    assert {r["id"]: r["repo"] for r in got.collect()} == {1: "thing", 2: "own", 3: None} and "cwd" not in got.columns


def test_temp_projects(spark):
    names = {"-private-var-folders-xy": True, "-tmp-a": True, "-private-tmp-b": True, "-Users-me-tmp-x": False, "-var-folders": False, "tmp-a": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["t"] for r in df.select("n", transcripts.is_temp_project(F.col("n")).alias("t")).collect()} == names


def test_hub_windows_count_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 12)
    rows = [(start, 1, "a"), (start + datetime.timedelta(days=3), 1, "b"), (start + datetime.timedelta(days=3), 1, "b"), (start + datetime.timedelta(days=60), 2, "z")]
    spark.createDataFrame(rows, "ts timestamp, id long, session string").coalesce(1).write.parquet(str(tmp_path / "in"))
    told = spark.readStream.schema("ts timestamp, id long, session string").parquet(str(tmp_path / "in"))
    q = live.hub_windows(told).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window"]["end"], r["sessions"]) for r in spark.read.parquet(str(tmp_path / "out")).where("id = 1").collect()}
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    assert {(day(1), 1), (day(14), 2), (day(17), 1)} <= got and max(n for _, n in got) == 2


def test_recent_days_alone_are_read(spark, tmp_path):
    lines = spark.createDataFrame([(datetime.datetime(2024, 1, d, 12), d) for d in (1, 2, 3, 8, 9)], "ts timestamp, n int")
    tables.append_turns(lines, str(tmp_path / "log"))
    got = tables.recent_turns(spark, str(tmp_path / "log"), "ts timestamp, n int", datetime.datetime(2024, 1, 9, 1), 7)
    assert sorted(r["n"] for r in got.collect()) == [3, 8, 9]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString() or "PartitionFilters: [day" in got._jdf.queryExecution().toString()  # older folders are left out


def test_batches_of_cases_beyond_the_bound_give_the_same_pairs(spark):
    cases = spark.range(7).select(F.col("id").alias("query_id"), (F.col("id") * 3).alias("decision"))
    rows = spark.range(20).select("id", F.col("id").alias("micros"))
    pairs = [sorted((r["query_id"], r["id"]) for r in eligibility.in_batches(cases, rows, F.col("micros") < F.col("decision"), most).collect()) for most in (100, 3, 1)]
    assert pairs[0] == [(q, i) for q in range(7) for i in range(20) if i < 3 * q] and pairs[1] == pairs[0] == pairs[2]
