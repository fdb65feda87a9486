"""Line sources, transcripts and keyed tables on files of our own."""

import json

import pytest
from pyspark.sql import functions as F

from lumenlog.sources import lines, tables, transcripts


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('{"a":1}\n{"a":2}\n\n{"a":3}\n{"a":4')
    (tmp_path / "p" / "b.jsonl").write_text("")
    (tmp_path / "p" / "auth.json").write_text("x\n")
    (tmp_path / "p" / "subagents").mkdir()
    (tmp_path / "p" / "subagents" / "c.jsonl").write_text("x\n")
    return tmp_path


def test_whole_lines_with_numbers_and_resume(spark, folder):
    got = lines.lines(spark, [str(folder / "p" / "a.jsonl")])
    assert [(r.line_no, r.value) for r in got.orderBy("line_no").collect()] == [(1, '{"a":1}'), (2, '{"a":2}'), (4, '{"a":3}')]
    seen = got.select("file").distinct().withColumn("lines", F.lit(2))
    assert [r.line_no for r in lines.lines(spark, [str(folder / "p" / "a.jsonl")], seen).collect()] == [4]
    assert lines.first_lines(got).first()["header"] == '{"a":1}'
    assert [r.line_no for r in lines.tail(got, 1).collect()] == [4]


def test_listing_leaves_credentials_subagents_and_empty_files_out(spark, folder):
    assert sorted(r.path.rsplit("/", 1)[1] for r in lines.listing(spark, [str(folder / "p")], "*.json*").collect()) == ["a.jsonl"]


def test_contract_rows_fail_loudly(spark):
    ok = spark.createDataFrame([("f", 1, '{"id":"x","n":2}')], "file string, line_no int, value string")
    assert lines.contract(ok, "id string, n int").first()["n"] == 2
    bad = spark.createDataFrame([("f", 7, '{"id":')], "file string, line_no int, value string")
    with pytest.raises(Exception, match="corrupt line 7"):
        lines.contract(bad, "id string, n int").collect()
    assert lines.contract(bad, "id string, n int", strict=False).first()["id"] is None


def test_incremental_files(spark):
    files = spark.createDataFrame([("a", 10), ("b", 20), ("c", 5), ("d", 1)], "path string, size long")
    state = spark.createDataFrame([("a", 10, 3), ("b", 12, 4), ("c", 9, 6)], "path string, size long, lines long")
    assert {(r.path, r.action, r.from_line) for r in lines.file_todo(files, state).collect()} == {("b", "grown", 4), ("c", "rewritten", 0), ("d", "new", 0)}


def test_rollouts(spark):
    rows = [
        ("r1", 1, {"type": "session_meta", "payload": {"id": "s1", "timestamp": "t", "cwd": "/w", "source": "cli"}}),
        ("r1", 2, {"type": "response_item", "timestamp": "t1", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fallback"}]}}),
        ("r1", 3, {"type": "event_msg", "timestamp": "t2", "payload": {"type": "item_completed", "item": {"type": "UserMessage", "content": [{"type": "text", "text": "typed"}]}}}),
        ("r2", 1, {"type": "session_meta", "payload": {"id": "s2", "source": {"subagent": "x"}}}),
        ("r3", 1, {"id": "s3", "timestamp": "t0"}),
        ("r3", 2, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "old"}]}),
        ("r4", 1, {"type": "session_meta", "payload": {"id": "s4", "source": "exec"}}),
    ]
    df = spark.createDataFrame([(f, n, json.dumps(v, separators=(",", ":"))) for f, n, v in rows], "file string, line_no int, value string")
    verdicts = {r.file: r.verdict for r in transcripts.session_verdict(lines.first_lines(df)).collect()}
    assert verdicts == {"r1": "interactive", "r2": "subagent", "r3": "legacy", "r4": "exec"}
    assert {(r.file, r.kind, r.raw) for r in transcripts.host_b(df).collect()} == {("r1", "fallback", "fallback"), ("r1", "event", "typed"), ("r3", "legacy", "old")}


def test_typed_logs(spark):
    rows = [{"session_id": "s", "ts": 5, "text": "hello"}, {"display": "/fix the [Pasted text #1 +2 lines] now", "pastedContents": {"1": {"type": "text", "content": "a$b"}}, "timestamp": 7000, "project": "/p", "sessionId": "t"}]
    df = spark.createDataFrame([("f", i, json.dumps(v)) for i, v in enumerate(rows)], "file string, line_no int, value string")
    got = {r.session_id: (r.micros, r.raw, r.command) for r in transcripts.typed_log(df).collect()}
    assert got == {"s": (5_000_000, "hello", None), "t": (7_000_000, "the a$b now", "/fix")}


def test_markers_and_tools(spark):
    rows = [{"type": "system", "subtype": "compact_boundary"}, {"type": "user", "isCompactSummary": True}, {"type": "compacted"}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Bash"}, {"type": "text", "text": "x"}, {"type": "tool_use", "name": "Read"}]}}]
    df = spark.createDataFrame([("f", i, json.dumps(v)) for i, v in enumerate(rows)], "file string, line_no int, value string")
    assert [r.marker for r in transcripts.compaction(df).orderBy("line_no").collect()] == ["boundary", "summary", "compacted"]
    assert [r.tools for r in transcripts.tool_calls(df).collect()] == [["Bash", "Read"]]


def test_turn_log_days(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "prompt"), ("2024-01-02 10:00:00", "stop")], "ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    tables.append_turns(df, str(tmp_path / "log"))
    got = tables.turn_log(spark, str(tmp_path / "log"), "ts timestamp, event string", ["2024-01-02"])
    assert [r.event for r in got.collect()] == ["stop"]
