"""Evaluation of ranked lists against gold: recall, reciprocal rank, bootstrap intervals, resumable replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.order import total_order
from lumenlog.sources.commits import KeyedTable
from lumenlog.sources.staging import staged

OUTPUT_SCHEMA = "query_id long, ranked array<struct<id: long, score: double>>"


def metrics(ranked: DataFrame, gold: DataFrame, digits: int = 6) -> DataFrame:
    """gold, recall@5, recall@10 and reciprocal rank of each query with gold: ranked (query_id, id, rank), gold (query_id, id)."""
    hit = gold.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id")
    share = lambda k: F.round(F.count_if(F.col("rank") <= k) / F.count("*"), digits)
    return hit.agg(F.count("*").alias("gold"), share(5).alias("recall5"), share(10).alias("recall10"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), digits).alias("rr"))


def bootstrap(values: DataFrame, draws: int = 200, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of values (query_id, value) under resampling: a row for each draw and place, no draw in one task.

    The place that a draw takes is a hash of draw, place and seed, by md5, so that any engine draws the same.
    """
    numbered = staged(total_order(values, [], F.asc("query_id"), name="place"), "values")
    n = numbered.count()
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    picks = numbered.select("place", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("draw", (hashed % F.lit(max(n, 1)) + 1).cast("int").alias("place"))
    means = picks.join(numbered, "place").groupBy("draw").agg(F.avg("value").alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def pending(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without an output yet; a case_id twice is an error."""
    twice = cases.groupBy("query_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a case is listed twice")
    return cases.join(done.select("query_id").distinct(), "query_id", "left_anti")


def resume(cases: DataFrame, outputs: KeyedTable, run: Callable[[DataFrame], DataFrame], batch: int = 1000) -> int:
    """Rank the cases that outputs (a table of OUTPUT_SCHEMA by query_id) lacks, `batch` at a time; how many were ranked.

    run: cases -> (query_id, id, score, rank). A batch is one commit, with a row for each case, empty where nothing was
    ranked, so a run that is stopped goes on where it was and asks for no case twice.
    """
    todo = staged(total_order(pending(cases, outputs.read()), [], F.asc("query_id"), name="_place"), "cases")
    total = todo.count()
    for at in range(0, total, batch):
        part = todo.where((F.col("_place") > at) & (F.col("_place") <= at + batch)).drop("_place")
        lists = run(part).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("x"))  # the head of a ranking
        ranked = F.transform(F.coalesce("x", F.array().cast("array<struct<rank: int, id: bigint, score: double>>")), lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score")))
        outputs.insert_or_ignore(staged(part.select("query_id").join(lists, "query_id", "left").select("query_id", ranked.alias("ranked")), "outputs"))
    return total
