"""Operators on small tables: boundaries, ties, order of suppression, state."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import eligibility, ranking, selection, temporal
from lumenlog.streaming import live, pairing

DAY = 86_400_000_000


def test_hubs_count_other_sessions_within_an_open_window(spark):
    now = 20 * DAY
    rows = [("a", 1, now - int(13.5 * DAY)), ("a", 2, now - int(14.5 * DAY)), ("a", 3, now + 1), ("a", 1, now - DAY), ("b", 1, now - 1), ("b", 2, now - 14 * DAY), ("c", 1, now - 2), ("c", 2, now - 1), ("c", 9, now - 1)]
    h = spark.createDataFrame(rows, "id string, session int, micros long")
    assert {r["id"] for r in selection.hub_ids(h, now, 14, 2, 9).collect()} == {"c"}
    assert selection.hub_ids(h, now, 14, 0).count() == 0


def test_dedupe_keeps_the_best_and_the_earliest_on_a_tie(spark):
    rows = [(0, 1, "A  b", 0.5, 1), (0, 2, "a b", 0.9, 2), (0, 3, "c", 0.4, 3), (0, 4, "C", 0.4, 4), (0, 5, "d", 0.1, 5)]
    r = spark.createDataFrame(rows, "query_id int, id int, text string, score double, rank int")
    assert sorted(x["id"] for x in selection.keep_best(r, ["query_id"]).collect()) == [2, 3, 5]


def test_gate_comes_before_the_cut_and_nulls_cannot_pass(spark):
    r = spark.createDataFrame([(0, i, p, i) for i, p in enumerate([0.1, None, float("nan"), 0.95, 0.99, 0.2, 1.0])], "query_id int, id int, p double, rank int")
    assert [x["id"] for x in selection.cut(selection.gate(r, "p", 0.95), 2).orderBy("place").collect()] == [3, 4]


@pytest.mark.parametrize(("chars", "kind", "reason"), [(299, "decision", None), (300, "decision", "cross-repo-long"), (499, "rule", "cross-repo-long")])
def test_length_limits_keep_out_at_the_limit(spark, chars, kind, reason):
    df = spark.createDataFrame([("x" * chars, kind, "r1", "r2", "assistant")], "text string, kind string, repo string, current_repo string, gist_source string")
    assert df.select(eligibility.precision_reason().alias("r")).first()["r"] == reason


def test_card_rules_against_a_plain_version(spark):
    kinds, scopes, repos = ["rule", "preference", "decision", "question", None], ["global", "repo", "unclear"], ["a", "b", None]
    rows = [(k, s, r, c) for k in kinds for s in scopes for r in repos for c in repos]
    df = spark.createDataFrame(rows, "kind string, scope string, repo string, current_repo string")
    for got in df.withColumn("ok", eligibility.card_allowed()).collect():
        same = got.repo is not None and got.repo == got.current_repo
        want = got.kind is not None and got.kind not in ("question", "status") and (same or (got.scope == "global" and got.kind in ("rule", "preference")))
        assert got.ok == want


def test_refused_items_come_last(spark):
    rows = [(0, 1, None, 1, 5), (0, 2, 0.2, 3, 4), (0, 3, 0.9, 4, 3), (0, 4, None, 2, 2), (0, 5, 0.2, 2, 1)]
    r = spark.createDataFrame(rows, "query_id int, id int, p double, emb_rank int, micros long").withColumn("k", ranking.judge_rank())
    assert [x["id"] for x in r.orderBy("k").collect()] == [3, 5, 2, 1, 4]


def test_prior_statement_is_strictly_before(spark):
    rows = [(1, 0, 10, "a"), (2, 0, 10, "b"), (3, 0, 11, "c"), (4, 1, 11, "d")]
    r = temporal.prior_statement(spark.createDataFrame(rows, "id long, session_id int, micros long, text string"))
    assert {x["id"]: x["prior_id"] for x in r.collect()} == {1: None, 2: None, 3: 2, 4: None}


def test_runs_end_after_an_idle_gap(spark):
    h = 3_600_000_000
    rows = [(1, 0, 0, "/auto", False), (1, h, 1, None, False), (1, 2 * h, 2, None, True), (1, 6 * h, 3, "/review", False), (1, 7 * h, 4, None, False), (1, 11 * h, 5, None, False), (1, 12 * h, 6, None, False), (2, 0, 7, None, False)]
    r = temporal.auto_runs(spark.createDataFrame(rows, "session_id long, micros long, at long, command string, image boolean"))
    assert {x["at"] for x in r.where("submission").collect()} == {1, 4}


LINES = [(1, "prompt", None), (2, "prompt", "a"), (3, "stop", "a"), (4, "stop", None), (5, "stop", None), (6, "stop", "b"), (7, "prompt", "b"), (8, "prompt", None), (9, "prompt", None), (10, "stop", "zz"), (11, "stop", None)]
PAIRED = {1: 1, 2: 2, 3: 2, 4: 1, 5: None, 6: None, 7: 7, 8: 8, 9: 9, 10: 9, 11: 7}


def test_pairing_fold():
    got = {at: p for at, _, p in pairing.pair(LINES, [], {})}
    assert got[3] == 2 and got[4] == 1 and got[5] is None and got[6] is None and got[10] == 9


def test_pairing_stream_equals_batch(spark, tmp_path):
    rows = [(s, at + 100 * s, e, k) for s in (1, 2, 3) for at, e, k in LINES]
    schema = "session_id long, at long, event string, turn_key string"
    want = {(r.session_id, r.at): r.prompt_at for r in temporal.pair_turns(spark.createDataFrame(rows, schema)).collect()}
    src = tmp_path / "in"
    src.mkdir()
    cut = [rows[i] for i in range(len(rows)) if rows[i][1] % 100 <= 5], [rows[i] for i in range(len(rows)) if rows[i][1] % 100 > 5]
    for i, part in enumerate(cut):
        pd.DataFrame(part, columns=["session_id", "at", "event", "turn_key"]).to_json(src / f"{i}.json", orient="records", lines=True)
    stream = pairing.pair_stream(live.tail(spark, str(src), schema, per_trigger=1))
    q = stream.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.session_id, r.at): r.prompt_at for r in spark.table("pairs").collect()} == want


def test_live_counters_and_publish(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    pd.DataFrame({"ts": ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"], "event": ["prompt", "stop"], "level": ["info", "error"]}).to_json(src / "a.json", orient="records", lines=True)
    lines = live.tail(spark, str(src), "ts timestamp, event string, level string")
    q = live.live_counters(lines).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[1:] for r in spark.table("counters").collect()] == [(2, 1, 1, 1)]
    seen = []
    live.publish(live.tail(spark, str(src), "ts timestamp, event string, level string"), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 2


def test_tally_keeps_the_newest(spark):
    df = spark.createDataFrame([(0, i, i, "r") for i in range(7)] + [(0, 9, 9, None)], "query_id int, id int, micros long, reason string")
    r = eligibility.tally(df, ["query_id"], newest=3).first()
    assert (r["n"], r["ids"]) == (7, [4, 5, 6])
    assert eligibility.tally(df.where(F.lit(False)), ["query_id"]).count() == 0
