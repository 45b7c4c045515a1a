"""Ranks and running sums over sorted rows without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlode.workspace import Workspace


def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column], amount: str | None = None, name: str = "rank") -> DataFrame:
    """Rows with the sum of amount (by default 1, so a rank from 1) over their group up to them.

    Rows are dealt out by ranges of group and order; a row's sum is that within its range
    plus the sums of the ranges before it. The dealt rows are written first, so both
    readings see the same ranges.
    """
    keys = [F.col(g) for g in group]
    dealt = rows.repartitionByRange(*(k.asc() for k in keys), *order).withColumn("_range", F.spark_partition_id())
    dealt = Workspace(rows.sparkSession, "ranges").save(dealt, "dealt")
    value = F.col(amount) if amount else F.lit(1)
    within = F.sum(value).over(Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = dealt.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range of a group
    base = sums.select("_range", *group, F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in ("_range", *group):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    joined = dealt.withColumn(name, within).alias("x").join(base.alias("y"), same)
    return joined.select(*(F.col(f"x.{c}") for c in rows.columns), (F.col(f"x.{name}") + F.col("y._before")).alias(name))
