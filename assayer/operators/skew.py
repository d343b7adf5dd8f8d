"""Bringing group-level results back to the rows, safe for hot groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import column

#: Groups that are broadcast at most: those with more than their even share of the rows by this count.
HOT_GROUPS = 50_000


def rows_of_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total_rows: int,
    hot_groups: int = HOT_GROUPS, sure: Column | None = None,
) -> DataFrame:
    """Rows of the listed groups with the groups' other columns, from one pass over ``rows``.

    ``groups`` has one row per group with its size in ``copies``, and should be
    written first, so that its true size is known when the join is planned: most
    tables have few offending groups or none, and those must not shuffle the
    table. Groups with at least ``total_rows / hot_groups`` rows number at most
    ``hot_groups``, so they are broadcast; their rows go through the second join
    under a key of their own, spread by the split they were read from. Rows for
    which ``sure`` holds are kept without a group.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    others = [c for c in groups.columns if c not in keys]
    marked = groups.select(*[column(k).alias(n) for k, n in zip(keys, names)], F.struct(*[column(c) for c in others]).alias("__group"))
    limit = total_rows / hot_groups

    def same(more: Column | None = None) -> Column:
        held = [column(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        return reduce(lambda a, b: a & b, held + ([] if more is None else [more]))

    hot = F.broadcast(marked.filter(F.col(f"__group.`{copies}`") >= limit).withColumnRenamed("__group", "__hot"))
    cold = marked.filter(F.col(f"__group.`{copies}`") < limit).withColumn("__away", F.lit(0)).withColumnRenamed("__group", "__cold")
    kept = rows.withColumn("__sure", F.lit(False) if sure is None else F.coalesce(sure, F.lit(False)))
    kept = kept.join(hot, same(), "left").drop(*names)
    settled = F.col("__sure") | F.col("__hot").isNotNull()
    kept = kept.withColumn("__apart", F.when(settled, F.spark_partition_id() + 1).otherwise(0))
    kept = kept.join(cold, same(F.col("__apart") == F.col("__away")), "left").drop(*names, "__away", "__apart")
    kept = kept.withColumn("__group", F.coalesce("__hot", "__cold")).filter(F.col("__sure") | F.col("__group").isNotNull())
    return kept.select(*[column(c) for c in rows.columns], *[F.col(f"__group.`{c}`").alias(c) for c in others])
