"""The issue register: I-SEV, I-BAND, I-ACTION, I-QUALITY, I-KEYS, I-ANOM, I-TRUNC, I-ANOMSUM, I-PRIO, I-COUNTS, I-FILTER."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.coerce import column
from assayer.operators.identity import POSITION, ROW_KEY
from assayer.operators.order_stats import quantiles
from assayer.plans import severity as S
from assayer.plans.profile import Profile
from assayer.session import settled, small_table

ISSUE_SCHEMA = (
    "issue_id string, severity string, severity_score double, source string, dimension string, rule_id string, "
    "scope string, table string, column string, n_records bigint, pct_affected double, reason string, "
    "recommended_action string, record_keys array<string>, evidence string"
)
REGISTER_COLUMNS = [
    "issue_id", "priority", "severity", "severity_score", "source", "dimension", "rule_id", "scope", "table",
    "column", "n_records", "pct_affected", "reason", "recommended_action", "record_keys", "evidence", "detected_at",
]


def severity_score(
    impact: Column, affected: Column, rows: Column, weight: Column, max_weight: float, confidence: Column,
    settings: S.Severity = S.SHIPPED,
) -> Column:
    """0-100 from impact, the square root of the affected share, and confidence."""
    extent = F.when(rows > 0, F.sqrt(affected / rows)).otherwise(F.lit(0.0))
    share = weight / max_weight if max_weight else F.lit(1.0)
    w = settings.weights
    blend = w["impact"] * impact + w["extent"] * extent + w["confidence"] * confidence
    return 100.0 * F.greatest(F.lit(S.LEAST_WEIGHT), share) * blend


def severity_band(score: Column, rule_id: Column, settings: S.Severity = S.SHIPPED) -> Column:
    family = F.substring_index(rule_id, ".", 1)
    always = settings.always_critical
    band = F.when(rule_id.isin(*always) | family.isin(*always), "critical")
    for low, level in settings.ordered_bands():
        band = band.when(score >= low, level)
    return band.otherwise("low")


def _choice(key: Column, table: dict[str, str]) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def action_for(rule_id: Column, settings: S.Severity = S.SHIPPED) -> Column:
    """Advice for the rule, else its family, else the general one."""
    family = F.substring_index(rule_id, ".", 1)
    rest = F.expr("substring(rule_id, length(substring_index(rule_id, '.', 1)) + 2)")
    specific = F.when(family == "consistency", _choice(rest, settings.rule_actions))
    return F.coalesce(specific, _choice(family, settings.actions), F.lit(settings.actions.get("anomaly", S.FAMILY_ACTIONS["anomaly"])))


def sample_keys(positioned_findings: DataFrame) -> DataFrame:
    """The first ten failing keys of each rule, in row order.

    The rank limit is applied before the shuffle, so a rule with a billion
    failures sends ten rows per task.
    """
    order = Window.partitionBy("rule_id").orderBy(POSITION, "row_key")
    first = positioned_findings.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= S.SAMPLE_KEYS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", "row_key"))), lambda x: x["row_key"])
    return first.groupBy("rule_id").agg(listed.alias("record_keys"))


def quality_issues(
    results: DataFrame, profile: Profile, table: str, keys: DataFrame | None = None, settings: S.Severity = S.SHIPPED
) -> DataFrame:
    """One issue per breached rule; ids count over all rules, so they have gaps."""
    weights = profile.weights
    n_failed, n_checked = F.col("n_failed"), F.greatest(F.lit(1), F.col("n_checked"))
    weight = F.coalesce(_choice_number(F.col("dimension"), weights), F.lit(S.UNKNOWN_DIMENSION_WEIGHT))
    confidence = F.when(F.col("dimension") == "plausibility", S.STATISTICAL_CONFIDENCE).otherwise(1.0)
    numbered = results.withColumn("__no", F.row_number().over(Window.orderBy("rule_id")))
    breached = numbered.filter((n_failed > 0) & (F.col("score") < S.PASSING_SCORE))
    scored = breached.withColumn("severity_score", severity_score(
        F.col("impact"), n_failed, n_checked, weight, max(weights.values(), default=1.0), confidence, settings))
    if keys is None:
        scored = scored.withColumn("record_keys", F.array().cast("array<string>"))
    else:
        scored = scored.join(F.broadcast(keys), "rule_id", "left")  # ten keys per rule
    share = n_failed / n_checked
    detail = F.map_concat(F.create_map(F.lit("rule_score"), F.bround("score", 6).cast("string")), F.col("detail"))
    return scored.select(
        F.format_string("ISS-Q%04d", "__no").alias("issue_id"),
        severity_band(F.col("severity_score"), F.col("rule_id"), settings).alias("severity"),
        "severity_score",
        F.lit("quality_rule").alias("source"), "dimension", "rule_id",
        F.when(F.col("column").isNotNull(), "column").otherwise("dataset").alias("scope"),
        F.lit(table).alias("table"), "column",
        n_failed.alias("n_records"), share.alias("pct_affected"),
        F.concat(F.col("description"), F.lit(". "), F.format_string("%,d of %,d", n_failed, F.col("n_checked")),
                 F.lit(" rows checked failed ("), F.format_string("%.2f%%", F.bround(share * 100, 2)),
                 F.lit(").")).alias("reason"),
        action_for(F.col("rule_id"), settings).alias("recommended_action"),
        F.coalesce("record_keys", F.array().cast("array<string>")).alias("record_keys"),
        F.to_json(detail).alias("evidence"))


def _choice_number(key: Column, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), key)


# --- flagged records --------------------------------------------------------------------


def anomaly_summary(scores: DataFrame, threshold: float, threshold_rule: str, model: str) -> dict[str, Any]:
    """Counts and quantiles of one scored batch; ``scores`` should be written or cached."""
    row = scores.agg(
        F.count("score").alias("n"), F.count_if(F.col("score") >= threshold).alias("flagged"),
        F.count_if(F.col("score") < threshold).alias("below"), F.max("score").alias("top")).first()
    median = quantiles(scores, {"score": [0.5]}, {"score": row["n"]})["score"][0]
    return {
        "model": model, "n_scored": row["n"], "n_flagged": row["flagged"],
        "flag_rate": row["flagged"] / max(1, row["n"]), "threshold_value": float(threshold),
        "threshold_rule": threshold_rule, "score_median": median or 1e-12, "score_max": row["top"] or 0.0,
        "share_below": row["below"] / max(1, row["n"]),
    }


def flagged_records(scores: DataFrame, threshold: float, limit: int) -> DataFrame:
    """The highest flagged scores; equal scores in row order."""
    return scores.filter(F.col("score") >= threshold).orderBy(F.desc("score"), POSITION).limit(limit)


def top_scored(rows: DataFrame, scores: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` highest-scoring rows with their score in front, equal scores in row order (A-TOP)."""
    top = scores.orderBy(F.desc("score"), POSITION).limit(n).select(POSITION, F.col("score").alias("anomaly_score"))
    kept = rows.join(F.broadcast(top), POSITION)  # at most n rows
    return kept.orderBy(F.desc("anomaly_score"), POSITION).select(
        "anomaly_score", *[column(c) for c in rows.columns if c not in (POSITION, ROW_KEY)])


def with_percentiles(top: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Adds the average-rank percentile among all ``n`` scores to the highest ones.

    Everything above a listed score is listed too, so ranks follow from the list;
    only the last score may tie with rows beyond it and is counted.
    """
    last = top.agg(F.min("score")).first()[0]
    ties = scores.filter(F.col("score") == last).count()
    above = F.rank().over(Window.orderBy(F.desc("score"))) - 1  # the list is short
    listed = F.count(F.lit(1)).over(Window.partitionBy("score"))
    equal = F.when(F.col("score") == F.lit(last), F.lit(ties)).otherwise(listed)
    return top.withColumn("percentile", (n - above - equal + (equal + 1) / 2) / n)


_TOP_FEATURES = 3


def top_features(names: list[str]) -> Column:
    """The features with the largest error and their share of it, from a row's errors, observed and expected values."""
    label = F.array(*[F.lit(n) for n in names])
    total = F.greatest(F.aggregate("errors", F.lit(0.0), lambda a, e: a + e), F.lit(1e-12))
    ranked = F.array_sort(F.transform("errors", lambda e, i: F.struct((-e).alias("below"), i.alias("at"))))
    return F.transform(F.slice(ranked, 1, _TOP_FEATURES), lambda r: F.struct(
        F.get(label, r["at"]).alias("feature"), (-r["below"]).alias("squared_error"),
        (-r["below"] / total).alias("share_of_error"), F.get("observed", r["at"]).alias("observed"),
        F.get("expected", r["at"]).alias("expected")))


@F.udf(T.StringType(), useArrow=False)
def _five_digits(value: float) -> str:
    """Five significant digits; the listed rows are few."""
    return f"{value:.5g}"


def _record_reason(median: float) -> Column:
    head = F.concat(
        F.lit("Anomaly score "), _five_digits("score"), F.format_string(" (%.4f%%", F.bround(F.col("percentile") * 100, 4)),
        F.format_string(" percentile, %.1fx the batch median).", F.bround(F.col("score") / F.lit(median), 1)))
    deviations = F.transform("top_features", lambda f: F.format_string(
        "%s (observed %.2f vs expected %.2f)", f["feature"], f["observed"], f["expected"]))
    return F.concat(head, F.when(F.size("top_features") > 0, F.concat(
        F.lit(" Largest deviations: "), F.concat_ws(", ", deviations), F.lit("."))).otherwise(""))


_EXPLAINED = ("array<struct<feature: string, squared_error: double, share_of_error: double, "
              "observed: double, expected: double>>")


def anomaly_issues(
    spark: SparkSession, scores: DataFrame, summary: dict[str, Any], table: str,
    max_issues: int = S.MAX_RECORD_ISSUES, explained: DataFrame | None = None, settings: S.Severity = S.SHIPPED,
) -> DataFrame:
    """One issue per flagged record up to the register's cap, and one for the rest.

    ``explained`` holds :func:`top_features` by position. The capped rows are
    written once, and all else is columns over them.
    """
    n, below = summary["n_scored"], summary["share_below"]
    rule_id, rest = f"anomaly.{summary['model']}", summary["n_flagged"] - min(max_issues, summary["n_flagged"])
    more = small_table(spark, [
        ("ISS-A0000", "medium", S.TRUNCATED_SCORE, "anomaly_model", "anomaly", f"{rule_id}.truncated", "dataset", table,
         None, rest, rest / n,
         f"{rest:,} further records exceeded the anomaly threshold but were not listed individually "
         f"(register capped at {max_issues}).", S.TRUNCATED_ACTION, [], f'{{"n_truncated": {rest}}}')] if rest else [],
        ISSUE_SCHEMA)
    if rest == summary["n_flagged"]:
        return more
    chosen = flagged_records(scores, summary["threshold_value"], max_issues).select(POSITION, ROW_KEY, "score")
    top = with_percentiles(settled(chosen), scores, n)
    if explained is None:
        top = top.withColumn("top_features", F.lit(None).cast(_EXPLAINED))
    else:
        top = top.join(explained.select(POSITION, "top_features"), POSITION, "left")
    one = F.lit(1.0)
    sure = F.least(one, F.greatest(F.lit(0.0), (F.col("percentile") - below) / max(1e-9, 1 - below)))
    place = F.row_number().over(Window.orderBy(F.desc("score"), POSITION))  # the list is short
    evidence = F.struct("score", "percentile", F.lit(summary["threshold_value"]).alias("threshold"), "top_features")
    listed = top.withColumn("severity_score", severity_score(F.lit(S.ANOMALY_IMPACT), one, F.lit(n), one, 1.0, sure, settings)).select(
        F.format_string("ISS-A%04d", place).alias("issue_id"),
        severity_band(F.col("severity_score"), F.lit(rule_id), settings).alias("severity"), "severity_score",
        F.lit("anomaly_model").alias("source"), F.lit("anomaly").alias("dimension"), F.lit(rule_id).alias("rule_id"),
        F.lit("record").alias("scope"), F.lit(table).alias("table"), F.lit(None).cast("string").alias("column"),
        F.lit(1).cast("bigint").alias("n_records"), F.lit(1 / n).alias("pct_affected"),
        _record_reason(summary["score_median"]).alias("reason"),
        F.lit(settings.actions.get("anomaly", S.FAMILY_ACTIONS["anomaly"])).alias("recommended_action"), F.array(ROW_KEY).alias("record_keys"),
        F.to_json(evidence).alias("evidence"))
    return listed.unionByName(more)


# --- the register -----------------------------------------------------------------------


def prioritized(parts: list[DataFrame]) -> DataFrame:
    """Rank all issues 1..N. A register is bounded by the rules and the record cap."""
    issues = reduce(DataFrame.unionByName, parts)
    order = Window.orderBy(
        F.desc("severity_score"), F.desc("n_records"), "rule_id",
        F.coalesce(F.try_element_at("record_keys", F.lit(1)), F.lit("")))
    return issues.withColumn("priority", F.row_number().over(order)).withColumn(
        "detected_at", F.current_timestamp()).select(
        *[F.bround(c, 2).alias(c) if c == "severity_score" else F.bround(c, 6).alias(c) if c == "pct_affected"
          else F.col(c) for c in REGISTER_COLUMNS])


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per level, all four levels present."""
    levels = small_table(issues.sparkSession, list(enumerate(S.LEVELS)), "rank int, severity string")
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(F.broadcast(counted), "severity", "left").orderBy("rank").select(
        "severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_issues"))


def by_severity(issues: DataFrame, levels: list[str]) -> DataFrame:
    return issues.filter(F.col("severity").isin(*levels))


# Columns of the short issue list.
TOP_COLUMNS = ("priority", "severity", "dimension", "rule_id", "n_records", "reason")


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The first n issues by priority, with the usual columns that exist (IO-TOPISSUES)."""
    return issues.orderBy("priority").limit(n).select(*[c for c in TOP_COLUMNS if c in issues.columns])
