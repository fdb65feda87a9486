"""From a ranked list to what is told: gate, repeats, hubs, duplicates, second gate, cut. In this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scoring as S
from lumenlog.functions.text import dedupe_key
from lumenlog.operators.ranking import row_rank

DAY = 86_400_000_000


def gate(ranked: DataFrame, column: str, least: float) -> DataFrame:
    """Rows that reach the bar; null and NaN can't."""
    return ranked.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.col(column) >= least))


def no_repeat(ranked: DataFrame, told: DataFrame, texts: DataFrame) -> DataFrame:
    """ranked (query_id, session, id, text) without ids, or texts of ids, that its session has been told: told (session, id)."""
    keys = told.join(texts.select("id", dedupe_key(F.col("text")).alias("key")), "id").select("session", "key").distinct()
    return ranked.withColumn("key", dedupe_key(F.col("text"))).join(told.select("session", "id").distinct(), ["session", "id"], "left_anti").join(keys, ["session", "key"], "left_anti").drop("key")


def hub_ids(history: DataFrame, now: int, days: float, most: int, session: object = None) -> DataFrame:
    """Ids told in at least `most` other sessions within the window, open at both ends; none when `most` is 0."""
    h = history.where((F.col("micros") > now - int(days * DAY)) & (F.col("micros") < now))
    if session is not None:
        h = h.where(F.col("session") != session)
    n = h.groupBy("id").agg(F.countDistinct("session").alias("sessions"))
    return n.where(F.col("sessions") >= most) if most else n.where(F.lit(False))


def hub_index(history: DataFrame) -> DataFrame:
    """Latest time an id was told in each session."""
    return history.groupBy("id", "session").agg(F.max("micros").alias("last"))


def keep_best(ranked: DataFrame, by: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """One row of each normalised text: the best scored, the earliest on a tie, at its own place."""
    w = Window.partitionBy(*by, dedupe_key(F.col("text"))).orderBy(F.desc(score), F.asc(rank))
    return ranked.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


def apply_gate(survivors: DataFrame, k: int, least: float = S.APPLY_GATE) -> DataFrame:
    """The second gate (query_id, apply_p, rank): the k best answered above the bar, ties in the earlier order."""
    passed = gate(survivors, "apply_p", least)
    return passed.withColumn("place", row_rank(["query_id"], F.desc("apply_p"), F.asc("rank"))).where(F.col("place") <= k)


def cut(passing: DataFrame, k: int) -> DataFrame:
    """The first k of what passed: never cut before the gate."""
    return passing.withColumn("place", row_rank(["query_id"], F.asc("rank"))).where(F.col("place") <= k)


def gate_rows(survivors: DataFrame, picked: DataFrame, least: float = S.APPLY_GATE) -> DataFrame:
    """Each survivor's verdict: injected, passed but cut, below the bar, or without an answer."""
    p = picked.select("query_id", "id", F.lit(True).alias("injected"))
    verdict = F.when(F.col("injected"), "injected").when(F.col("apply_p").isNull(), "no-answer").when(F.col("apply_p") >= least, "cut").otherwise("below")
    return survivors.join(p, ["query_id", "id"], "left").withColumn("verdict", verdict).drop("injected")


def survivors(ranked: DataFrame, p: str, least: float, told: DataFrame, texts: DataFrame, hubs: DataFrame) -> DataFrame:
    """What may be told, in its order, before any cut: gate, what the session was told, hubs (id), copies of a text.

    ranked: (query_id, session, id, rank) with the column p and a score; told: (session, id); texts: (id, text).
    Texts are joined to what passed the gate alone.
    """
    passing = gate(ranked, p, least).join(texts.select("id", "text"), "id")
    return keep_best(no_repeat(passing, told, texts).join(hubs.select("id").distinct(), "id", "left_anti"), ["query_id"])


def carried(turns: DataFrame, hashes: DataFrame, uuids: DataFrame) -> DataFrame:
    """Distinct ids of turns (session, id, text_hash, uuid) that a compaction carried over, by text hash or by uuid of the session."""
    by_hash = turns.join(hashes.select("session", "text_hash"), ["session", "text_hash"], "left_semi").select("session", "id")
    return by_hash.union(turns.join(uuids.select("session", "uuid"), ["session", "uuid"], "left_semi").select("session", "id")).distinct()


def packs(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with the number of the pack of `size` that each goes into, from 0, within by."""
    return rows.withColumn("pack", F.floor((row_rank(by, *map(F.asc, order)) - 1) / size).cast("int"))
