"""Scores and grade from rule results: S-DIM, S-GEO, S-ARITH, S-GRADE, S-DIMTABLE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.operators.uniqueness import KEY_RULE
from assayer.plans.profile import DIMENSIONS, Profile
from assayer.session import small_table

# Floor under the logarithm, grade bands and the cap for a failed dimension.
SCORE_FLOOR = 0.01
GRADE_BANDS = ((90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D"))
COLLAPSED = 0.50


def dimension_scores(results: DataFrame, profile: Profile) -> DataFrame:
    """Weighted mean score per dimension; a dimension without rules has weight 0."""
    spark = results.sparkSession
    fixed = small_table(
        spark, [(i, d, float(profile.weights.get(d, 0.0))) for i, d in enumerate(DIMENSIONS)],
        "rank int, dimension string, declared double")
    scored = results.groupBy("dimension").agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("s"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_failed") > 0).alias("bad"))
    return fixed.join(F.broadcast(scored), "dimension", "left").select(
        "rank", "dimension",
        F.coalesce("s", F.lit(1.0)).alias("score"),
        F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("declared")).alias("weight"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("rules"),
        F.coalesce("bad", F.lit(0)).cast("bigint").alias("failed_rules"))


def dimension_table(results: DataFrame, profile: Profile) -> DataFrame:
    """The same in report form, scores on a 0-100 scale."""
    return dimension_scores(results, profile).orderBy("rank").select(
        "dimension", F.bround(F.col("score") * 100, 2).alias("score"), "weight", "rules", "failed_rules")


def quality_summary(results: DataFrame, profile: Profile, table: str, n_rows: int, n_columns: int) -> DataFrame:
    """Global geometric and arithmetic score and the grade, in one row."""
    dims = dimension_scores(results, profile)
    weight, score = F.col("weight"), F.col("score")
    means = dims.agg(
        F.sum(weight).alias("w"),
        F.sum(weight * F.ln(F.greatest(score, F.lit(SCORE_FLOOR)))).alias("logs"),
        F.sum(weight * score).alias("plain"),
        F.min(F.when(F.col("rules") > 0, score)).alias("weakest"))
    broken = results.agg(F.count_if((F.col("rule_id") == KEY_RULE) & (F.col("n_failed") > 0)).alias("broken_keys"))
    # both sides are single rows
    both = means.withColumn("one", F.lit(1)).join(broken.withColumn("one", F.lit(1)), "one")
    usable = F.col("w") > 0
    both = both.select(
        F.when(usable, 100 * F.exp(F.col("logs") / F.col("w"))).otherwise(F.lit(0.0)).alias("global_score"),
        F.when(usable, 100 * F.col("plain") / F.col("w")).otherwise(F.lit(0.0)).alias("global_score_arithmetic"),
        "weakest", "broken_keys")
    band = None
    for low, letter in GRADE_BANDS:
        test = F.col("global_score") >= low
        band = F.when(test, letter) if band is None else band.when(test, letter)
    capped = F.when((F.col("weakest") < COLLAPSED) & F.col("band").isin("A", "B", "C"), "D").otherwise(F.col("band"))
    graded = both.withColumn("band", band.otherwise("F"))
    return graded.select(
        F.lit(table).alias("table"),
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(n_columns).cast("int").alias("n_columns"),
        "global_score", "global_score_arithmetic",
        F.when(F.col("broken_keys") > 0, "F").otherwise(capped).alias("grade"),
        F.lit(profile.inferred).alias("profile_inferred"),
        F.current_timestamp().alias("generated_at"))
