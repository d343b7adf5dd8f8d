"""Rules measured against the ledger: D-UNION, D-RECALL, D-PRECISION, D-SUMMARY."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

STATISTICAL_DIMENSIONS = ("plausibility",)
ANY_COLUMN = "*"


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def defect_recall(ledger: DataFrame, findings: DataFrame) -> DataFrame:
    """Injected and recovered defects per family.

    A defect counts as recovered when a finding names its row and its column, or
    a finding on its row names no column. Findings shrink to one row per flagged
    row, holding at most as many names as there are columns, before they move.
    """
    flagged = findings.groupBy("table", "row_key").agg(
        F.collect_set(F.coalesce("column", F.lit(ANY_COLUMN))).alias("columns"))
    hit = F.col("columns").isNotNull() & (
        F.col("column").isNull()
        | F.array_contains("columns", F.col("column"))
        | F.array_contains("columns", ANY_COLUMN))
    judged = ledger.join(flagged, ["table", "row_key"], "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return judged.groupBy("table", "defect_code").agg(
        F.count(F.lit(1)).alias("injected"), F.count_if("hit").alias("detected")
    ).withColumn("recall", F.bround(F.col("detected") / F.col("injected"), 4)).orderBy("table", "defect_code")


def rule_precision(ledger: DataFrame, findings: DataFrame) -> DataFrame:
    """Flagged rows per rule and how many of them carry any known defect."""
    counted = findings.groupBy("table", "row_key", "rule_id", "dimension").agg(F.count(F.lit(1)).alias("n"))
    corrupted = ledger.select("table", "row_key").distinct().withColumn("known", F.lit(True))
    judged = counted.join(corrupted, ["table", "row_key"], "left")
    summary = judged.groupBy("table", "rule_id", "dimension").agg(
        F.sum("n").alias("flagged"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("true_positives"))
    return summary.withColumn("precision", F.bround(F.col("true_positives") / F.col("flagged"), 4)).withColumn(
        "is_statistical", F.col("dimension").isin(*STATISTICAL_DIMENSIONS)).orderBy(
        "is_statistical", "precision", "table", "rule_id")


def engine_summary(recall: DataFrame, precision: DataFrame) -> DataFrame:
    """Totals over both tables, in one row."""
    found = recall.agg(
        F.sum("injected").alias("defects_injected"), F.sum("detected").alias("defects_detected"),
        F.bround(F.sum("detected") / F.sum("injected"), 4).alias("overall_recall"),
        F.count_if(F.col("recall") == 1.0).alias("families_at_full_recall"),
        F.count(F.lit(1)).alias("n_families")).withColumn("one", F.lit(1))
    sure = precision.filter(~F.col("is_statistical")).agg(
        F.bround(F.sum("true_positives") / F.sum("flagged"), 4).alias("deterministic_rule_precision")
    ).withColumn("one", F.lit(1))
    return found.join(sure, "one").drop("one")  # single rows on both sides
