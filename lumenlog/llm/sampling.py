"""Bounded training samples and held-out folds of the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the longest text that a sample sent to the driver takes, which bounds its bytes.
LONGEST = 20_000


def fold(n: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def by_text_hash(rows: DataFrame, n: int, total: int) -> DataFrame:
    """About n distinct rows of `total` (never more than 2 n), chosen by a hash of their text alone."""
    share = 1.0 if total <= n else n / total
    kept = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else rows
    return kept.dropDuplicates(["text"]).limit(2 * n)


def by_group(rows: DataFrame, group: str, n: int, total: int) -> DataFrame:
    """About n distinct (group, text) rows of each group (never more than 2 n), chosen by a hash of the text; about `total` of all.

    Texts longer than LONGEST aren't taken.
    """
    rows = rows.where(F.length("text") <= LONGEST)
    counts = rows.groupBy(group).count()
    n = min(n, max(1, total // max(1, counts.count())))
    some = rows.join(counts, group).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.ceil(1_000_000 * F.lit(float(n)) / F.col("count")))
    first = Window.partitionBy(group).orderBy(F.xxhash64("text"), "text")
    return some.select(group, "text").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= 2 * n).drop("nth")


def labelled(docs: DataFrame, labels: DataFrame, column: str, n_folds: int, held_out: int, n: int) -> DataFrame:
    """A sample (text, y) of labelled rows outside the held-out fold; a doc_id with clashing labels is left out."""
    y = labels.where(F.col(column).isNotNull() & (fold(n_folds) != held_out)).groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("z")).where("y = z")
    total = y.count()
    share = min(1.0, 2 * n / max(total, 1))
    some = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else y  # keeps the join small
    return by_text_hash(docs.where("text is not null").select("doc_id", "text").join(some, "doc_id").select("text", F.col("y").cast("int").alias("y")), n, min(total, 2 * n))
