"""Looking at a labelled table: M-EDA, M-SEP, M-HOURDENS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import column, missing
from assayer.operators.order_stats import quantiles


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and their share of all rows."""
    counted = df.groupBy(column(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counted.withColumn("share", F.col("n") / F.lit(float(max(1, total))))


def class_describe(df: DataFrame, label: str, measure: str) -> DataFrame:
    """Count, mean, spread and exact, interpolated quartiles of a measure per class; there are few classes."""
    value, group = column(measure), column(label)
    stats = df.groupBy(group.alias("class")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    seen = stats.select("class", "n").collect()
    parts = df.select(*[F.when(group.eqNullSafe(F.lit(r["class"])), value).alias(f"v{i}") for i, r in enumerate(seen)])
    found = quantiles(parts, {f"v{i}": [0.25, 0.5, 0.75] for i, _ in enumerate(seen)},
                      {f"v{i}": r["n"] for i, r in enumerate(seen)})

    def quartile(at: int) -> Column:
        return F.coalesce(F.lit(None).cast("double"), *[
            F.when(F.col("class").eqNullSafe(F.lit(r["class"])), F.lit(found[f"v{i}"][at])) for i, r in enumerate(seen)])

    return stats.select("class", "n", "mean", "std", "min", quartile(0).alias("p25"), quartile(1).alias("p50"),
                        quartile(2).alias("p75"), "max")


def missing_totals(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    counted = df.agg(*[F.count_if(missing(column(c), df.schema[c].dataType)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), column(c).alias("n_missing")) for c in df.columns])
    return counted.select(F.explode(cells).alias("c")).select("c.*")


def deviation_spread(df: DataFrame, names: list[str]) -> DataFrame:
    """Smallest and largest standard deviation among columns."""
    row = df.agg(*[F.stddev_samp(column(n)).alias(f"s{i}") for i, n in enumerate(names)])
    parts = [F.col(f"s{i}") for i in range(len(names))]
    return row.select(F.array_min(F.array(*parts)).alias("min_std"), F.array_max(F.array(*parts)).alias("max_std"))


def class_separation(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Distance between class means in standard deviations, per feature, widest first."""
    flag = column(label)
    aggs = [a.alias(f"{k}{i}") for i, n in enumerate(names) for k, a in (
        ("p", F.avg(F.when(flag == 1, column(n)))), ("q", F.avg(F.when(flag == 0, column(n)))),
        ("s", F.stddev_samp(column(n))))]
    gaps = F.array(*[
        F.struct(F.lit(n).alias("feature"),
                 F.when(F.col(f"s{i}") > 0, F.abs(F.col(f"p{i}") - F.col(f"q{i}")) / F.col(f"s{i}"))
                 .alias("separation")) for i, n in enumerate(names)])
    return df.agg(*aggs).select(F.explode(gaps).alias("g")).select("g.*").orderBy(F.desc("separation"))


def hour_density(df: DataFrame, hour: Column, label: str, bins: int = 48) -> DataFrame:
    """Density of each class over the hours of the day; each class integrates to 1."""
    width = 24.0 / bins
    place = F.least(F.lit(bins - 1), F.floor(hour / width)).cast("int")
    counted = df.groupBy(place.alias("bin"), column(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("class").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "class").select(  # one row per class
        "bin", "class", "n", (F.col("n") / F.col("total") / width).alias("density"))


