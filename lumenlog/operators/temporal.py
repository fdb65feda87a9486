"""Joins and frames over time and position: as-of, intervals, patterns, neighbours, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import norm


def prior_statement(rows: DataFrame, by: str = "session_id") -> DataFrame:
    """The last statement of the session strictly before each one, in (micros, id) order; equal times are not before."""
    w = Window.partitionBy(by).orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    prior = F.max(F.struct("micros", "id", "text")).over(w)
    return rows.withColumn("prior_id", prior["id"]).withColumn("prior_text", prior["text"])


def context_before(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each owner turn the last assistant turn before it, and the last owner turn with another text."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("key", F.when(F.col("role") == "user", norm(F.col("text"))))
    t = t.withColumn("assistant_before", F.last(F.when(F.col("role") == "assistant", F.col(order)), ignorenulls=True).over(w))
    # the newest owner turn before, and the newest whose text differs from that one: one of the two differs from this text
    last = F.last(F.when(F.col("key").isNotNull(), F.struct(F.col(order).alias("at"), F.col("key"))), ignorenulls=True).over(w)
    t = t.withColumn("last", last).withColumn("changed", F.when(F.col("key").isNotNull() & (F.col("last").isNull() | (F.col("last.key") != F.col("key"))), F.col("last")))
    other = F.last("changed", ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return t.where(F.col("role") == "user").select(by, order, F.col("assistant_before").alias("assistant_turn"), F.when(F.col("last.key") != F.col("key"), F.col("last.at")).otherwise(other["at"]).alias("owner_turn"))


def frame(turns: DataFrame, targets: DataFrame, before: int, after: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows from `before` places before each target to `after` places after it: turns (by, order), targets (target_id, by, order)."""
    numbered = turns.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    at = targets.join(numbered.select(by, order, F.col("place").alias("target_place")), [by, order]).select("target_id", by, "target_place")
    near = at.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(1), F.col("target_place") - before), F.col("target_place") + after)))
    return near.join(numbered, [by, "place"]).withColumn("offset", F.col("place") - F.col("target_place"))


def adjacent_runs(rows: DataFrame, by: list[str], order: str, same: Column) -> DataFrame:
    """Gaps and islands: rows for which `same` holds share a run with their neighbours; every other row is its own."""
    w = Window.partitionBy(*by).orderBy(order)
    s = F.coalesce(same, F.lit(False))
    t = rows.withColumn("same", s)
    starts = ~F.col("same") | ~F.coalesce(F.lag("same").over(w), F.lit(False))
    return t.withColumn("run", F.sum(starts.cast("long")).over(w))


def event_precedence(turns: DataFrame, by: str = "file", kind: str = "kind") -> DataFrame:
    """Where a file has any event turn, its fallback turns go."""
    has = F.max((F.col(kind) == "event").cast("int")).over(Window.partitionBy(by)) == 1
    return turns.withColumn("has_event", has).where(~F.col("has_event") | (F.col(kind) == "event")).drop("has_event")


def span_verdict(turns: DataFrame, spans: DataFrame, named: DataFrame, typed: DataFrame, now: int, settle: int = 600_000_000) -> DataFrame:
    """Interval and pattern join of rollout turns with typed logs: keep, wait, or the reason to drop.

    turns (home, session_id, micros, text); spans (home, first, last); named (session_id): sessions the
    logs name; typed (session_id, typed): their rows, a paste placeholder standing for any text.
    """
    young = now - F.col("micros") < settle
    t = turns.withColumn("key", norm(F.col("text")))
    rows = typed.select("session_id", norm(F.col("typed")).alias("typed")).where("typed <> ''").withColumn("pattern", paste_pattern(F.col("typed")))
    matched = t.join(rows, "session_id").where(F.when(F.col("pattern").isNull(), F.col("key") == F.col("typed")).otherwise(F.expr("key rlike pattern"))).select("turn_id").distinct()
    j = t.join(matched.withColumn("typed", F.lit(True)), "turn_id", "left").join(named.select("session_id", F.lit(True).alias("named")).distinct(), "session_id", "left").join(spans, "home", "left")
    verdict = (
        F.when(F.col("named") & F.coalesce("typed", F.lit(False)), "keep").when(F.col("named"), F.when(young, "wait").otherwise("code-turn-not-typed"))
        .when(F.col("micros").between(F.col("first"), F.col("last")), "code-session-not-typed").when((F.col("micros") > F.col("last")) & young, "wait").otherwise("keep")
    )
    return j.select("turn_id", verdict.alias("verdict"))


def paste_pattern(typed: Column) -> Column:
    """A pattern for typed rows with paste placeholders, else null."""
    holder = r"\[Pasted Content \d+ chars\]"
    parts = F.transform(F.split(typed, holder), lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.when(typed.rlike(holder), F.concat(F.lit("(?s)^"), F.array_join(parts, ".*"), F.lit("$")))


def number_times(turns: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Turns that share a time: each one's number in file order, and whether it is alone."""
    w = Window.partitionBy(*by, time)
    return turns.withColumn("ts_seq", F.row_number().over(w.orderBy(order)) - 1).withColumn("ts_alone", F.count("*").over(w) == 1)


def turn_identity(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """The held statement of each candidate's turn: by exact key, else a lone loose one if the candidate is alone, else by line.

    Both have (id, exact, loose, line); the first held id of a key wins.
    """
    exact = held.where("exact is not null").groupBy("exact").agg(F.min_by("id", "seq").alias("by_exact"))
    loose = held.where("loose is not null").groupBy("loose").agg(F.min_by("id", "seq").alias("by_loose"), F.count("*").alias("n")).where("n = 1").drop("n")
    line = held.where("line is not null").groupBy("line").agg(F.min_by("id", "seq").alias("by_line"))
    j = candidates.join(exact, "exact", "left").join(loose.withColumnRenamed("loose", "time_key"), "time_key", "left").join(line, "line", "left")
    found = F.coalesce("by_exact", F.when(F.col("ts_alone") & F.col("exact").isNotNull(), F.col("by_loose")), "by_line")
    return j.select("id", F.when(found != F.col("id"), found).alias("other_id"))


RUN_IDLE = 3 * 3600 * 1_000_000
#: 2025-10-23T00:00Z in microseconds: from then on the host keeps its runs' rows apart (fixed value).
RUNS_PERSISTED_BEFORE = 1_761_177_600_000_000


def fold(rows: DataFrame, by: str, order: list[str], new: Callable[[], list], step: Callable[[list, dict], tuple], schema: str) -> DataFrame:
    """Rows of each key in order through a step with the key's state, for decisions that depend on earlier decisions.

    Partitions are sorted by Spark, which spills, and read batch by batch: a task holds one batch and
    one key's state, however many rows the key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), new()
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row[by] != key:
                    key, state = row[by], new()
                out.append(step(state, row))
            fields = _arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def auto_runs(rows: DataFrame, by: str = "session_id", idle: int = RUN_IDLE, before: int | None = None) -> DataFrame:
    """Rows (by, micros, at, command, image) that a program submitted: within a run that its start row opens and an idle gap ends.

    before: rows from that time on (`RUNS_PERSISTED_BEFORE` in the logs of the host) are no submissions and change no run.
    """

    def step(state: list, r: dict) -> tuple:
        last, at, submission = state[0], r["micros"], False
        if before is not None and at >= before:
            return r[by], r["at"], False
        if r["command"] == "/auto":
            state[0] = at
        elif last is not None and at - last >= idle and not r["command"]:
            state[0] = None
        elif last is not None:
            state[0] = at
            submission = at - last < idle and not r["image"]
        return r[by], r["at"], submission

    kind = dict(rows.dtypes)
    return fold(rows, by, ["micros", "at"], lambda: [None], step, f"{by} {kind[by]}, at {kind['at']}, submission boolean")


def throttle(events: DataFrame, by: str, window: int) -> DataFrame:
    """Events (by, micros, at) that are loud: the first of each window, a window beginning at the last loud one."""

    def step(state: list, r: dict) -> tuple:
        loud = state[0] is None or r["micros"] - state[0] >= window
        if loud:
            state[0] = r["micros"]
        return r[by], r["at"], loud

    kind = dict(events.dtypes)
    return fold(events, by, ["micros", "at"], lambda: [None], step, f"{by} {kind[by]}, at {kind['at']}, loud boolean")


def pair_turns(lines: DataFrame) -> DataFrame:
    """Prompts with their stops, by turn key, else the newest open prompt before: lines (session_id, at, event, turn_key)."""
    from lumenlog.streaming.pairing import PAIR_SCHEMA, pair

    def step(state: list, r: dict) -> tuple:
        return (r["session_id"], *pair([(r["at"], r["event"], r["turn_key"])], *state)[0])

    return fold(lines, "session_id", ["at"], lambda: [[], {}], step, PAIR_SCHEMA)
