"""Running totals over a global order, without one task holding the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import settled


def running_totals(
    df: DataFrame, order: list[Column], sums: list[str], group: list[str] | None = None
) -> DataFrame:
    """Add ``cum_<name>``: the inclusive running total of each column, per group.

    Rows are range-partitioned into slices and the slices written once, so both
    levels read the same slices. The totals of earlier slices come from a table
    with one row per slice and group. Callers pass one row per order value, so a
    frequent value cannot fill a slice.
    """
    group = group or []
    keys = [F.col(g).asc() for g in group]
    sliced = settled(df.repartitionByRange(*keys, *order).withColumn("__slice", F.spark_partition_id()))
    totals = sliced.groupBy(*group, "__slice").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__slice",
                            *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inner = Window.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = sliced.select("*", *[F.sum(s).over(inner).alias(f"__i_{s}") for s in sums])
    # at most slices + groups rows, as consecutive slices share at most one group
    full = within.join(F.broadcast(offsets), [*group, "__slice"])
    return full.select(*df.columns, *[(F.col(f"__i_{s}") + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums])
