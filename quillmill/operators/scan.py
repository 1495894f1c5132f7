"""Prefix scans and positions over a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialized


def running_total(df: DataFrame, order: list[str], value: str, out: str, *, by: str | None = None) -> DataFrame:
    """df (narrow, with distinct orders) with the total of `value` over the rows before, in all or within `by`.

    Rows are range-partitioned by order and kept so; totals of whole partitions come from their
    sums, which are few, and those of rows from a window within a partition.
    """
    group = [by] if by else []
    placed = df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id())
    placed = materialized(placed)
    sums = placed.groupBy(*group, "_pid").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialized(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long"))).drop("_sum"))
    within = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out_col = F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0).cast("long"))
    return placed.join(broadcast_if_small(sums), [*group, "_pid"]).withColumn(out, out_col).drop("_pid", "_offset")


def numbered(df: DataFrame, order: list[str], out: str, *, by: str | None = None) -> DataFrame:
    """df with each row's place in the global order, from 0."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out, by=by).drop("_one")
