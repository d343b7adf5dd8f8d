"""Outlier rule Q-OUTLIER: robust z-scores from median and MAD.

Three small aggregates fit all outlier columns together; the filter itself is
then a row rule and rides along with the other row-local rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import as_number, column
from assayer.operators.order_stats import quantiles
from assayer.operators.rules import RowRule
from assayer.plans.profile import Profile

# Fixed values of the robust z-score.
MIN_VALUES = 30
LOG_SKEW = 2.0
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349


@dataclass(frozen=True)
class OutlierFit:
    column: str
    count: int
    median: float
    scale: float
    cut: float
    log_scaled: bool

    def scaled(self, df: DataFrame) -> Column:
        return _scaled(as_number(column(self.column), df.schema[self.column].dataType), self.log_scaled)


def _scaled(number: Column, log_scaled: bool) -> Column:
    return F.log1p(number) if log_scaled else number


def sample_skewness(population: float | None, n: int) -> float:
    """Bias-adjusted skewness from Spark's population skewness."""
    if population is None or math.isnan(population) or n < 3:
        return 0.0
    return population * math.sqrt(n * (n - 1)) / (n - 2)


def fit_outliers(df: DataFrame, profile: Profile, cut: float | None = None) -> list[OutlierFit]:
    names = [c for c in profile.outlier_columns if c in df.columns]
    if not names:
        return []
    numbers = df.select(*[as_number(column(c), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(names)])
    row = numbers.agg(*[
        agg.alias(f"{label}{i}") for i in range(len(names))
        for label, agg in (("n", F.count(f"v{i}")), ("low", F.min(f"v{i}")), ("skew", F.skewness(f"v{i}")))
    ]).first()
    kept = [i for i in range(len(names)) if row[f"n{i}"] >= MIN_VALUES]
    if not kept:
        return []
    logs = {i: row[f"low{i}"] >= 0 and sample_skewness(row[f"skew{i}"], row[f"n{i}"]) > LOG_SKEW for i in kept}
    counts = {f"v{i}": row[f"n{i}"] for i in kept}
    scaled = numbers.select(*[_scaled(F.col(f"v{i}"), logs[i]).alias(f"v{i}") for i in kept])
    centre = quantiles(scaled, {f"v{i}": [0.5, 0.25, 0.75] for i in kept}, counts)
    distance = scaled.select(*[F.abs(F.col(f"v{i}") - F.lit(centre[f"v{i}"][0])).alias(f"v{i}") for i in kept])
    spread = quantiles(distance, {f"v{i}": [0.5] for i in kept}, counts)
    fits = []
    for i in kept:
        median, first, third = centre[f"v{i}"]
        scale = MAD_TO_SIGMA * spread[f"v{i}"][0]
        if not scale > 0:
            scale = (third - first) / IQR_TO_SIGMA
        if scale > 0:
            used = profile.outlier_cut if cut is None else cut
            fits.append(OutlierFit(names[i], counts[f"v{i}"], median, scale, used, logs[i]))
    return fits


def outlier_rules(df: DataFrame, fits: list[OutlierFit]) -> list[RowRule]:
    rules = []
    for fit in fits:
        value = fit.scaled(df)
        rules.append(RowRule(
            f"expect_column_values_to_be_plausible.{fit.column}", "plausibility", fit.column,
            f"'{fit.column}' values beyond {fit.cut} robust standard deviations of the median", 0.35, 1.0,
            checked=value.isNotNull(), failed=F.abs(value - fit.median) / fit.scale > fit.cut,
            detail={"median": fit.median, "robust_scale": fit.scale, "cut": fit.cut, "log_scaled": fit.log_scaled}))
    return rules
