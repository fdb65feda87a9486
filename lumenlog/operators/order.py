"""Total orders and running sums over groups of any size: by range partitions, never one group in one task.

Rows are dealt by ranges of (group, order), sorted within each range and staged. What a range holds of each group
is summed, and those sums, one row for each group and range that has it, give the place at which the range
goes on. Ranges cut within a group, so that one group of all rows spreads over all tasks; the order's last
column should be unique, as equal rows meet in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.sources.staging import staged

_PART, _AT = "_order_part", "_order_at"


def _placed(rows: DataFrame, by: list[str], order: tuple[Column, ...]) -> DataFrame:
    """rows with their range and their place in it."""
    keys = [*(F.col(c) for c in by), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return staged(ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, at), "order")


def _before(parts: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """For each group and range, the sums over the group's earlier ranges."""
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*by, _PART, *[c for c in parts.columns if c not in (*by, _PART, *sums)], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def _joined(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """Join by group and range, where null groups are groups too."""
    parts = parts.select(*[F.col(c).alias(f"_p_{c}") for c in parts.columns])
    on = F.col(_PART) == F.col(f"_p_{_PART}")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return rows.join(parts, on)


def total_order(rows: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """rows with `name`, the place 1, 2, 3, ... of each in its group."""
    placed = _placed(rows, by, order)
    parts = placed.groupBy(*by, _PART).agg(F.count("*").alias("n"), F.min(_AT).alias("first"))
    out = _joined(placed, _before(parts, by, ["n"]), by)
    return out.select(*rows.columns, (F.col("_p_n") + F.col(_AT) - F.col("_p_first") + 1).cast("int").alias(name))


def running(rows: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """rows with each of `sums` replaced by its sum over the group up to and with the row."""
    placed = _placed(rows, by, tuple(order))
    parts = placed.groupBy(*by, _PART).agg(*[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy(_PART, *by).orderBy(_AT)  # a group's rows in one range
    within = placed.select(*[c for c in placed.columns if c not in sums], *[F.sum(c).over(inside).alias(c) for c in sums])
    out = _joined(within, _before(parts, by, sums), by)
    return out.select(*[(F.col(c) + F.col(f"_p_{c}")).alias(c) if c in sums else F.col(c) for c in rows.columns])
