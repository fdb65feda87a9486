"""Versioned backfill: a new version of the rules judges held lines again and writes only what changes.

Statements are a keyed table by src, with the version of the rules that each row was judged under. A line that a version
has judged isn't judged by it again. Kept rows stay in their files: that they are up to date follows from the version
that their source is stamped with in `stamps`, a second keyed table (src, version), so a bump rewrites stamps, which are
small, and of the statements only the buckets that hold a rewritten, retired or added row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.commits import KeyedTable
from lumenlog.sources.staging import staged
from lumenlog.sources.tables import rejudge_actions

STATEMENT_SCHEMA = "src string, id string, text string, version int"
STAMP_SCHEMA = "src string, version int"
RETIRED_SCHEMA = "src string, id string, text string, reason string, version int"


def outdated(lines: DataFrame, stamps: KeyedTable, version: int) -> DataFrame:
    """Lines (src, ...) that this version hasn't judged: new ones, and those stamped with another version."""
    judged = stamps.read().where(F.col("version") == version).select("src")
    return lines if judged.isEmpty() else lines.join(judged, "src", "left_anti")  # a new version judges all: no text is sent


def mark(text: str) -> Column:
    """32 bytes by which texts are compared, so that comparisons don't send texts."""
    return F.unhex(F.sha2(F.col(text), 256))


def decide(held: DataFrame, judged: DataFrame) -> DataFrame:
    """(src, old_id, new_id, action, reason) for each judged line (src, id, text, reason; no text: rejected).

    A rewritten statement keeps its id. A rewrite or an addition to an id that another line's statement holds, or that a
    smaller src of the pass makes as well, is that turn again: the held one retires with that reason, the new one is dropped.
    """
    held, judged = held.select("src", "id", mark("text").alias("text")), judged.select("src", "id", mark("text").alias("text"), "reason")
    actions = rejudge_actions(held.join(judged.select("src").distinct(), "src", "left_semi"), judged)
    elsewhere = held.select(F.col("src").alias("other"), F.col("id").alias("new_id")).groupBy("new_id").agg(F.collect_set("other").alias("others"))
    made = actions.where(F.col("action").isin("add", "rewrite")).groupBy("new_id").agg(F.min("src").alias("first"))
    j = actions.join(elsewhere, "new_id", "left").join(made, "new_id", "left")
    others = F.size(F.filter(F.coalesce("others", F.array().cast("array<string>")), lambda o: o != F.col("src"))) > 0
    again = F.col("action").isin("add", "rewrite") & (others | (F.col("first") != F.col("src")))
    action = F.when(again & (F.col("action") == "rewrite"), "retire").when(again, "drop").otherwise(F.col("action"))
    return j.select("src", "old_id", "new_id", action.alias("action"), F.when(again, F.lit("turn-held-by-another-statement")).otherwise(F.col("reason")).alias("reason"))


def backfill(statements: KeyedTable, stamps: KeyedTable, retired: KeyedTable, lines: DataFrame, judge, version: int) -> dict[str, int]:
    """Judge what this version hasn't judged and bring the three tables up to it; how many rows had each action.

    lines: (src, ...); judge: lines -> (src, id, text, reason). The statements are committed last but for the stamps, so
    a crash between leaves lines to be judged again, with the same outcome.
    """
    todo = staged(judge(outdated(lines, stamps, version)).select("src", "id", "text", "reason"), "judged")
    held = statements.read()
    done = staged(decide(held, todo), "actions")
    counts = {r["action"]: r["count"] for r in done.groupBy("action").count().collect()}
    gone = staged(done.where("action = 'retire'").select("src", "reason"), "gone")  # its size is known, and mostly small: held texts stay where they are
    new = done.where("action in ('add', 'rewrite')").select("src", F.coalesce("old_id", "new_id").alias("id"))
    new = new.join(todo.select("src", "text"), "src").select("src", "id", "text", F.lit(version).alias("version"))
    if counts.get("retire"):
        retired.insert_or_ignore(gone.join(held.select("src", "id", "text"), "src").select("src", "id", "text", "reason", F.lit(version).alias("version")))
    if {"add", "rewrite", "retire"} & set(counts):
        statements.replace(new, retired=gone.select("src"), properties={"rules": str(version)})
    stamps.replace(todo.select("src", F.lit(version).alias("version")))
    return counts
