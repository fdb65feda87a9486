"""Session nodes: the statements of a thread in chunks, scored as one, then opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import ITEM_CLIP, clip
from lumenlog.operators.ranking import row_rank

CHUNK, NODE_CLIP, TOP_NODES = 24, 2400, 32


def chunks(items: DataFrame, by: list[str], order: list[str], size: int = CHUNK, most: int = NODE_CLIP) -> DataFrame:
    """Each item's chunk start in its session, and whether its line still begins inside the clipped node text."""
    w = Window.partitionBy(*by).orderBy(*order)
    t = items.withColumn("start", (F.floor((F.row_number().over(w) - 1) / size) * size).cast("int")).withColumn("line", clip(F.col("text"), ITEM_CLIP))
    inside = Window.partitionBy(*by, "start").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("line") + 1).over(inside), F.lit(0))
    return t.withColumn("offset", offset.cast("int")).withColumn("visible", F.col("offset") < most)


def nodes(chunked: DataFrame, by: list[str], order: list[str], most: int = NODE_CLIP) -> DataFrame:
    """(by, start, members, visible, text, emb_rank): at most a chunk's lines are collected."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"])
    return chunked.groupBy(*by, "start").agg(
        F.count("*").alias("members"), F.sum(F.col("visible").cast("long")).alias("visible"), clip(F.array_join(lines, "\n"), most).alias("text"), F.min("emb_rank").alias("emb_rank")
    )


def node_rank() -> Column:
    """Answered nodes by probability, ties by best member, then session and start."""
    return F.when(F.col("node_p").isNotNull(), row_rank(["query_id"], F.col("node_p").desc_nulls_last(), F.asc("emb_rank"), F.asc("session_id"), F.asc("start")))


def item_scores(items: DataFrame, n: Column) -> DataFrame:
    """Items (p, node_p, node_rank, emb_rank): opened and answered ones by blend, the others below in embedding order."""
    opened = (F.col("node_rank") <= TOP_NODES) & F.col("p").isNotNull()
    blend = 0.75 * (F.col("p") + F.col("node_p")) / 2 + 0.25 / F.log2(F.col("emb_rank") + 1)
    score = F.when(F.coalesce(opened, F.lit(False)), blend).otherwise(-1 - F.col("emb_rank") / (n + 1))
    return items.withColumn("score", F.round(score, 9)).withColumn("rank", row_rank(["query_id"], F.desc("score"), F.asc("emb_rank")))
