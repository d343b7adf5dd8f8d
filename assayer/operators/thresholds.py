"""Decision thresholds: T-BUDGET, T-TRAINPCT, T-BESTF1, and A-FLAG, A-CAUGHT."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.order_stats import quantiles
from assayer.session import small_table

REVIEW_BUDGET = 0.005
BUDGET_SWEEP = (0.001, 0.005, 0.01, 0.02)


@dataclass(frozen=True)
class Threshold:
    name: str
    value: float
    rule: str
    expected_flag_rate: float
    is_oracle: bool = False

    def as_row(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, [tuple(asdict(self).values())],
                           "name string, value double, rule string, expected_flag_rate double, is_oracle boolean")


def review_budgets(calibration: DataFrame, budgets: tuple[float, ...] = (REVIEW_BUDGET,)) -> list[Threshold]:
    """Cut-offs that flag the given shares of unlabelled calibration scores."""
    values = quantiles(calibration, {"score": [1.0 - b for b in budgets]})["score"]
    return [
        Threshold(f"budget@{b:.2%}", v, f"{(1 - b) * 100:.2f}th percentile of unlabelled calibration scores", b)
        for b, v in zip(budgets, values)
    ]


def review_budget(calibration: DataFrame, budget: float = REVIEW_BUDGET) -> Threshold:
    return review_budgets(calibration, (budget,))[0]


def train_percentile(train: DataFrame, percentile: float = 99.0) -> Threshold:
    """A percentile of the training scores; shown for contrast, as it flags too much on new data."""
    value = quantiles(train, {"score": [percentile / 100]})["score"][0]
    return Threshold(f"train_p{percentile:g}", value, f"{percentile:g}th percentile of training reconstruction error",
                     1.0 - percentile / 100.0)


def best_f1(scored: DataFrame) -> Threshold:
    """The cut with the highest F1 on labelled rows, the lowest such cut on a tie. Reads the labels."""
    from assayer.operators.metrics import score_steps

    steps = score_steps(scored)
    size = steps.agg(F.max("cum_pos").alias("p"), F.max("cum_n").alias("n")).first()
    f1 = 2 * F.col("cum_pos") / (F.col("cum_n") + F.lit(size["p"]))
    best = steps.select(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg"), "cum_n").alias("b")).agg(
        F.max("b").alias("b")).first()["b"]
    return Threshold("best_f1_oracle", -best["neg"],
                     "argmax F1 over labelled test scores (uses labels; not deployable)",
                     best["cum_n"] / size["n"], True)


def flagged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("flag", F.col("score") >= threshold)


def caught(flagged_scores: DataFrame) -> DataFrame:
    """Known positives and how many of them were flagged."""
    label = F.coalesce(F.col("label"), F.lit(0))
    return flagged_scores.agg(
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("n_labelled_positives"),
        F.count_if((label == 1) & F.col("flag")).alias("n_caught"))
