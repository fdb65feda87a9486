"""Excerpts against a plain walk over generated transcripts; errors; visible sets of single cases."""

import random

import pytest

from lumenlog.operators import excerpts as X

ITEMS = "file string, line long, role string, kind string, text string, tools array<string>"
TARGETS = "target_id long, file string, line long, statement string"


def transcript(rng, file):
    rows, line = [], 0
    for i in range(rng.randint(3, 25)):
        line += rng.randint(1, 3)
        if rng.random() < 0.45:
            rows.append((file, line, None, None, None, [rng.choice("abc") for _ in range(rng.randint(1, 2))]))
            continue
        role = rng.choice(["user", "assistant"])
        kinds = ["event", "fallback"] if rng.random() < 0.6 else [rng.choice(["event", "fallback"])]
        for kind in kinds:
            rows.append((file, line, role, kind, f"{role} {i}", None))
            line += 1
        if role == "assistant" and rng.random() < 0.4:
            rows.append((file, line - 1, None, None, None, ["inline"]))
    return rows


def walk(rows, target, before, after):
    """As a reader goes: one copy of each turn, groups merged, turns counted."""
    ordered = sorted(rows, key=lambda r: (r[1], r[2] is None))
    at = next(r for r in ordered if r[1] == target and r[2])
    kept = []
    for r in ordered:
        if r[2] and r[3] != at[3]:
            continue
        kept.append(r)
    i = kept.index(at)
    first = i
    seen = 0
    for j in range(i - 1, -1, -1):
        if kept[j][2]:
            if seen == before:
                break
            seen, first = seen + 1, j
    head = kept[first:i] if seen else []
    tail, seen = [], 0
    for j in range(i + 1, len(kept)):
        if after == 0:
            break
        r = kept[j]
        if seen == after and not (r[2] is None and r[1] == tail[-1][1] and any(x[2] for x in tail if x[1] == r[1])):
            break
        tail.append(r)
        seen += r[2] is not None
    if after and seen == after:
        last = max(r[1] for r in tail if r[2])
        tail = [r for r in tail if r[1] <= last]
    out = []
    for r in [*head, at, *tail]:
        if r[2] is None and out and out[-1][0] is None:
            out[-1][2].extend(r[5])
        else:
            out.append([r[2], r[4], list(r[5]) if r[5] else None, r is at])
    return [tuple(x) for x in out]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (2, 0), (0, 2), (3, 2), (100, 100)])
def test_excerpts_equal_a_walk(spark, before, after):
    rng = random.Random(before * 10 + after)
    rows = [r for f in range(12) for r in transcript(rng, f"f{f}")]
    targets = [(i, r[0], r[1], f" {r[4]}  ") for i, r in enumerate(rows) if r[2] == "user"]
    got = {}
    out = X.excerpts(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(targets, TARGETS), before, after)
    for r in out.orderBy("target_id", "pos").collect():
        got.setdefault(r["target_id"], []).append((r["role"], r["text"], list(r["tools"]) if r["tools"] else None, r["recalled"]))
    assert got == {i: walk([r for r in rows if r[0] == f], line, before, after) for i, f, line, _ in targets}


def test_another_text_at_the_line_is_an_error(spark):
    rows = spark.createDataFrame([("f", 1, "user", "event", "said", None), ("f", 2, "assistant", "event", "x", None)], ITEMS)
    for line, text in ((1, "other"), (2, "x"), (9, "said")):
        with pytest.raises(Exception, match="is not the statement"):
            X.excerpts(rows, spark.createDataFrame([(1, "f", line, text)], TARGETS), 1, 1).collect()


def test_visible_by_place_time_hash_and_prompt(spark):
    corpus = spark.createDataFrame([(1, "s", 10, "h1", "a"), (2, "s", 90, "h2", "b"), (3, "s", 90, "h3", "c"), (4, "s", 10, "h4", "d"), (5, "other", 5, "h5", "now"), (6, "other", 99, "h1", "e")], "id long, session_id string, micros long, text_hash string, said string")
    turns = spark.createDataFrame([("s", 3, 4), ("s", 1, 20)], "session_id string, id long, line long")
    carried = spark.createDataFrame([("s", "h4")], "session_id string, text_hash string")
    ask = lambda line, micros, prompt: sorted(r["id"] for r in X.still_visible(corpus, spark.createDataFrame([(0, "s", line, micros, prompt)], "query_id long, session_id string, boundary_line long, boundary_micros long, said string"), turns, carried).collect())
    assert ask(10, 50, "now") == [1, 2, 4, 5]  # 1 by place, 2 by time, 3 hidden by place, 4 carried over, 5 said
    assert ask(None, None, "") == [1, 2, 3, 4]
