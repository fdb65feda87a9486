"""Transcript excerpts around statements, what a session still sees, statements in the live index, who is attended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import norm
from lumenlog.operators.temporal import adjacent_runs

#: Sources of a rollout that a person drives (fixed values).
INTERACTIVE_SOURCES = ("cli", "vscode")


def targets_found(items: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target_id, file, line, statement) with kind and place, where that line is the owner's turn with that text.

    An error names what isn't: a file that was rewritten, or another one.
    """
    turns = items.where("role is not null").withColumn("place", F.row_number().over(Window.partitionBy("file", "kind").orderBy("line")))
    here = turns.where("role = 'user'").select("file", "line", "kind", "place", norm(F.col("text")).alias("said"))
    j = targets.join(here, ["file", "line"], "left")
    same = F.col("said").isNotNull() & (F.col("said") == norm(F.col("statement")))
    lost = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file").cast("string"), F.lit(" is not the statement"))).cast("string")
    return j.withColumn("kind", F.when(same, F.col("kind")).otherwise(lost)).select("target_id", "file", "line", "kind", "place")


def excerpts(items: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """The conversation around each target: (target_id, pos, role, line, text, tools, recalled), pos from 1 on.

    items (file, line, role, kind, text, tools): turns have a role and a kind, tool groups neither; a line may have a turn
    and a group after it. Of a turn that a host writes twice, only the copy of the target's kind counts. `before` turns
    before the target and `after` turns after it are counted over those; tool groups that touch once the other copies
    are gone are one, none comes before the first turn, and one on the last turn's line or, where the turns end, after
    it stays.
    """
    numbered = items.where("role is not null").select("file", "kind", "line", F.row_number().over(Window.partitionBy("file", "kind").orderBy("line")).alias("place"))
    at = targets_found(items, targets)
    ends = lambda name, place: numbered.select("file", "kind", F.col("place").alias(place), F.col("line").alias(name))
    at = at.withColumn("lo", F.greatest(F.lit(1), F.col("place") - before)).withColumn("hi", F.col("place") + after)
    at = at.join(ends("from_line", "lo"), ["file", "kind", "lo"]).join(ends("to_line", "hi"), ["file", "kind", "hi"], "left")
    at = at.select("target_id", "file", F.col("kind").alias("own"), F.col("line").alias("target_line"), "from_line", "to_line")
    near = items.join(at, "file").where((F.col("line") >= F.col("from_line")) & (F.col("to_line").isNull() | (F.col("line") <= F.col("to_line"))) & (F.col("role").isNull() | (F.col("kind") == F.col("own"))))
    near = near.withColumn("order", F.col("line") * 2 + F.col("role").isNull().cast("int"))
    near = near.where((F.lit(after) > 0) | (F.col("order") <= F.col("target_line") * 2))
    runs = adjacent_runs(near, ["target_id"], "order", F.col("role").isNull())
    said = runs.groupBy("target_id", "run").agg(
        F.min("order").alias("order"), F.min("line").alias("line"), F.first("role", ignorenulls=True).alias("role"), F.first("text", ignorenulls=True).alias("text"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("order", "tools"))), lambda x: x["tools"])).alias("tools"), F.bool_or((F.col("line") == F.col("target_line")) & F.col("role").isNotNull()).alias("recalled"),
    )
    pos = F.row_number().over(Window.partitionBy("target_id").orderBy("order"))
    return said.select("target_id", pos.alias("pos"), "role", "line", F.when(F.col("role").isNotNull(), F.col("text")).alias("text"), F.when(F.col("role").isNull(), F.col("tools")).alias("tools"), "recalled")


def in_live_index(statements: DataFrame, live: DataFrame) -> DataFrame:
    """statements (host, text, micros, src, ...) with src and via: their own, or that of the live statement with their host, text and time.

    Of live statements that are alike the last one by id counts; without one via is null. Null hosts are alike.
    """
    key = F.sha2(norm(F.col("text")), 256)
    known = live.where("src is not null").groupBy("host", "micros", key.alias("said")).agg(F.max_by("src", "id").alias("live_src"))
    lost = statements.withColumn("said", F.when(F.col("src").isNull(), key))
    on = lost["host"].eqNullSafe(known["host"]) & (lost["micros"] == known["micros"]) & (lost["said"] == known["said"])
    j = lost.join(known, on, "left").select(*[lost[c] for c in statements.columns if c != "src"], lost["src"].alias("own_src"), "live_src")
    return j.withColumn("src", F.coalesce("own_src", "live_src")).withColumn("via", F.when(F.col("own_src").isNotNull(), "transcript").when(F.col("live_src").isNotNull(), "index")).drop("own_src", "live_src")


def still_visible(corpus: DataFrame, queries: DataFrame, turns: DataFrame, carried: DataFrame) -> DataFrame:
    """Distinct (query_id, id): statements that a query's session has before it, and so needn't be told.

    corpus (id, session_id, micros, text_hash, said); queries (query_id, session_id, boundary_line, boundary_micros, said):
    the compaction boundary, null where none is proven, and the prompt; turns (session_id, id, line): statements whose
    turn the transcript still has; carried (session_id, text_hash): what a compaction carried over; said: normalised text.

    Position wins where the transcript has the turn, else time; without a boundary all of the session is visible. What was
    carried over and what the prompt says is visible whatever its place.
    """
    asked = queries.withColumnRenamed("said", "prompt")
    placed = turns.join(asked.where("boundary_line is not null").select("query_id", "session_id", "boundary_line"), "session_id")
    placed = placed.groupBy("query_id", "id").agg(F.bool_or(F.col("line") < F.col("boundary_line")).alias("hidden"), F.bool_or(F.col("line") >= F.col("boundary_line")).alias("shown"))
    own = corpus.join(asked.select("query_id", "session_id", "boundary_line", "boundary_micros"), "session_id").join(placed.select("query_id", "id", "hidden"), ["query_id", "id"], "left")
    own = own.join(carried.select("session_id", "text_hash").distinct().withColumn("kept", F.lit(True)), ["session_id", "text_hash"], "left")
    later = ~F.coalesce("hidden", F.lit(False)) & (F.col("micros") >= F.col("boundary_micros"))
    seen = own.where(F.col("boundary_line").isNull() | F.coalesce("kept", F.lit(False)) | F.coalesce(later, F.lit(False))).select("query_id", "id")
    by_prompt = corpus.join(asked.where("prompt <> ''").select("query_id", F.col("prompt").alias("said")), "said").select("query_id", "id")
    return seen.union(placed.where("shown").select("query_id", "id")).union(by_prompt).distinct()


def rollout_verdict(host: Column, path: Column, meta: Column, originator: Column, source: Column, source_keys: Column, thread: Column) -> Column:
    """The verdict on a session whose rollout says who drives it: interactive only on positive evidence.

    path: of the rollout; meta: whether it has session metadata; source: a string one, source_keys: the names in one that is
    an object; thread: the metadata's thread source.
    """
    told = lambda why, x: F.concat(F.lit(why), x)
    subagent = F.coalesce(thread == "subagent", F.lit(False)) | source_keys.isNotNull()
    run = F.coalesce(source == "exec", F.lit(False)) | F.coalesce(originator.rlike("(^|_)exec$"), F.lit(False))
    other = F.when(host == "codex", ~F.coalesce(thread == "user", F.lit(False))).otherwise(F.coalesce((thread != "") & (thread != "user"), F.lit(False)))
    return (
        F.when(path.isNull() | (path == ""), F.concat(F.lit("unknown:"), host, F.lit("-no-rollout"))).when(~F.coalesce(meta, F.lit(False)), F.concat(F.lit("unknown:"), host, F.lit("-no-session-meta")))
        .when(subagent, "headless:rollout-subagent").when(run, "headless:rollout-exec").when(other, told("headless:rollout-thread-source-", F.coalesce(thread, F.lit("none"))))
        .when(source.isin(*INTERACTIVE_SOURCES), told("interactive:rollout-", source)).otherwise(told("unknown:rollout-source-", F.coalesce(source, F.lit("none"))))
    )


def session_verdict(host: Column, settings: Column, rollout: Column) -> Column:
    """By host: that of the host that says itself whether a person is there, of the two with rollouts, or none known."""
    return F.when(host == "claude", settings).when(host.isin("codex", "code"), rollout).otherwise(F.concat(F.lit("unknown:host-"), host))
