"""Rows against what tables hold: what is missing, conflicts, days, re-judging, moved files. Writes are in commits.py."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't held yet: what is left to embed, card, ask or evaluate."""
    return rows.join(held.select(*keys).distinct(), keys, "left_anti")


def conflicts(rows: DataFrame, held: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose key is held with another value (null equals null)."""
    return rows.join(held.select(*keys, F.col(value).alias("held_value")), keys).where(~F.col(value).eqNullSafe(F.col("held_value")))


def turn_log(spark: SparkSession, path: str, schema: str, days: list[str] | None = None) -> DataFrame:
    """Turn-log lines partitioned by day=YYYY-MM-DD folders; days prune the folders read."""
    rows = spark.read.schema(f"{schema}, day string").json(path)
    return rows.where(F.col("day").isin(days)) if days else rows


def recent_turns(spark: SparkSession, path: str, schema: str, now: datetime.datetime, days: int = 7) -> DataFrame:
    """The log of the last `days` UTC days, today's among them: older folders are not read."""
    return turn_log(spark, path, schema, [(now - datetime.timedelta(days=n)).strftime("%Y-%m-%d") for n in range(days)])


def append_turns(lines: DataFrame, path: str) -> None:
    lines.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def rejudge_actions(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Re-judged lines against held statements (src, id, text): keep, rewrite, retire or add."""
    j = held.select("src", F.col("id").alias("old_id"), F.col("text").alias("old_text")).join(fresh.select("src", F.col("id").alias("new_id"), F.col("text").alias("new_text"), "reason"), "src", "full_outer")
    action = F.when(F.col("old_id").isNull() & F.col("new_text").isNotNull(), "add").when(F.col("old_id").isNull(), "drop").when(F.col("new_text").isNull(), "retire").when(F.col("old_text") != F.col("new_text"), "rewrite").otherwise("keep")
    return j.select("src", "old_id", "new_id", action.alias("action"), "reason")


def moved_files(fresh: DataFrame, vanished: DataFrame) -> DataFrame:
    """New paths of files that were read under another folder of their home: joined by base name, where only one vanished has it."""
    name = F.element_at(F.split("path", "/"), -1)
    v = vanished.withColumn("name", name).groupBy("home", "name").agg(F.count("*").alias("n"), F.min("path").alias("old_path")).where("n = 1")
    return fresh.withColumn("name", name).join(v, ["home", "name"]).select("home", "path", "old_path")


def repaired_repos(statements: DataFrame, cwds: DataFrame, repo) -> DataFrame:
    """Statements without a repo take the one that their file's working directory names; repo: cwd Column -> Column."""
    return statements.join(cwds, "file", "left").withColumn("repo", F.coalesce("repo", repo(F.col("cwd")))).drop("cwd")
