"""Every registered query: (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.hashing import uniform
from assayer.operators import explore, metrics
from assayer.operators.consistency import as_references, reference_entries
from assayer.operators.defects import changed_cells, inject_defects
from assayer.operators.features import FEATURES, Scaler, card_features, normals, plain_features, temporal_split
from assayer.operators.forest import ForestConfig, ForestModel, fit_forest, mean_path, tree_samples
from assayer.operators.groups import Entry, group_counts, verdicts
from assayer.operators.identity import FILE_ROWS, POSITION, ROW_KEY, with_identity, with_position
from assayer.operators.issues import (
    anomaly_issues, anomaly_summary, by_severity, prioritized, quality_issues, sample_keys, severity_counts,
    top_issues, top_scored,
)
from assayer.operators.plausibility import fit_outliers, outlier_rules
from assayer.operators.quality import QualityRun
from assayer.operators.reconstruct import AutoencoderConfig, AutoencoderModel, fit_autoencoder, fit_pca
from assayer.operators.rules import RowRule, completeness_rules, expression_rules, rule_results as scored_rules, tally, validity_rules
from assayer.operators.scoring import dimension_table, quality_summary
from assayer.operators.supervised import fit_logistic
from assayer.operators.thresholds import (
    BUDGET_SWEEP, best_f1, caught, flagged, review_budget, review_budgets, train_percentile,
)
from assayer.operators.uniqueness import KEY_RULE, UNIQUE_RULE, equal_rows, row_duplicate_counts, row_rule, uniqueness_entries
from assayer.plans.audit import AuditConfig, audit_batch, score_with_fallback
from assayer.plans.bundled import bundled_profiles
from assayer.plans.inference import infer_profile, profile_table, resolve_profile
from assayer.plans.measure import Measurement, measure_rules
from assayer.plans.profile import ColumnSpec, CrossRule, Profile, detect_profile, load_profile
from assayer.session import scratch_path, settled, small_table, write_text
from assayer.sources.models import ModelBundle, calibration_scores, load_bundle, save_bundle
from assayer.sources.reports import findings_by_rule, read_reports, read_top_issues, write_report
from assayer.sources.tables import Contract, checked_contract, most_recent, read_reference_dir, read_table, write_recent_sample, write_tables
from workload import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RESULT = ["rule_id", "dimension", "column", "description", "n_checked", "n_failed", "score", "impact", "weight"]
FOREST = ForestConfig()
AUTOENCODER = AutoencoderConfig()


def query(name: str) -> Callable[[Query], Query]:
    def register(body: Query) -> Query:
        QUERIES[name] = body
        return body

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def results(df: DataFrame) -> DataFrame:
    return rounded(df.select(*RESULT))


def row_results(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    return results(scored_rules(tally(df, rules), rules))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def today() -> Column:
    return F.lit(B.TODAY).cast("timestamp")


# --- rules on headers with every kind of violation --------------------------------------


def header_run(spark: SparkSession, folder: str) -> QualityRun:
    refs = {"customer": B.table(spark, folder, "customer")}
    batch = with_position(B.dirty_headers(spark, folder))  # read by many rules, joined once
    return QualityRun(batch, B.HEADERS, refs, "orders", B.TODAY, ["o_orderkey"])


@query("completeness_scores")
def completeness_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = B.dirty_headers(spark, folder)
    return row_results(df, completeness_rules(df, B.HEADERS))


def _validity(family: str) -> Query:
    def body(spark: SparkSession, folder: str) -> DataFrame:
        df = B.dirty_headers(spark, folder)
        rules = [r for r in validity_rules(df, B.HEADERS, today()) if r.rule_id.startswith(family + ".")]
        return row_results(df, rules)

    return body


for _name, _family in (
    ("type_parse_failures", "expect_column_values_to_be_of_type"),
    ("range_violations", "expect_column_values_to_be_between"),
    ("date_range_violations", "expect_column_dates_to_be_between"),
    ("vocabulary_violations", "expect_column_values_to_be_in_set"),
    ("regex_violations", "expect_column_values_to_match_regex"),
):
    QUERIES[_name] = _validity(_family)


def grouped_results(df: DataFrame, entries: list[Entry]) -> DataFrame:
    counts = group_counts(verdicts(df, entries), entries, df.count())
    return results(scored_rules(counts, [m.rule for e in entries for m in e.members]))


@query("row_duplicates")
def row_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    df = B.dirty_headers(spark, folder)
    total, first = df.count(), uniqueness_entries(df, B.HEADERS)[:1]
    equal = equal_rows(df, first[0], verdicts(df, first), total)
    return results(scored_rules(row_duplicate_counts(equal, total), [row_rule()]))


def _uniqueness(rule: str) -> Query:
    def body(spark: SparkSession, folder: str) -> DataFrame:
        df = B.dirty_headers(spark, folder)
        return grouped_results(df, uniqueness_entries(df, B.HEADERS)).filter(F.col("rule_id").startswith(rule))

    return body


QUERIES["primary_key_collisions"] = _uniqueness(KEY_RULE)
QUERIES["column_uniqueness"] = _uniqueness(UNIQUE_RULE)


@query("lineitem_key_collisions")
def lineitem_key_collisions(spark: SparkSession, folder: str) -> DataFrame:
    df = B.table(spark, folder, "lineitem")
    return grouped_results(df, uniqueness_entries(df, B.LINEITEM))


@query("expression_consistency")
def expression_consistency(spark: SparkSession, folder: str) -> DataFrame:
    df = B.dirty_headers(spark, folder)
    return row_results(df, expression_rules(df, B.HEADERS))


def _consistency(kind: str) -> Query:
    def body(spark: SparkSession, folder: str) -> DataFrame:
        df = B.dirty_headers(spark, folder)
        profile = B.HEADERS.with_(rules=[r for r in B.HEADERS.rules if r.kind == kind])
        refs = as_references({"customer": B.table(spark, folder, "customer")})
        return grouped_results(df, reference_entries(df, profile, refs))

    return body


QUERIES["foreign_key_orphans"] = _consistency("foreign_key")
QUERIES["lookup_mismatches"] = _consistency("lookup_match")


@query("header_totals")
def header_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals against the sum of their lines; one total in a hundred is off by one."""
    lines = B.table(spark, folder, "lineitem")
    off = F.when(uniform(F.col("l_orderkey"), "sum") < 0.01, 1.0).otherwise(0.0)
    heads = lines.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s")).select(
        F.col("l_orderkey").alias("order_id"), (F.round("s", 2) + off).alias("total"))
    rule = CrossRule("total_is_sum_of_lines", "group_total", "Total must equal the sum of its lines", 0.8,
                     column="total", local_key="order_id", ref_table="lines", ref_key="l_orderkey",
                     ref_column="l_extendedprice")
    profile = Profile("heads", columns=(ColumnSpec("order_id"), ColumnSpec("total")), rules=(rule,))
    refs = as_references({"lines": lines})
    return grouped_results(heads, reference_entries(heads, profile, refs))


@query("ship_before_order")
def ship_before_order(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped before their order date, on the joined tables."""
    lines, orders = B.table(spark, folder, "lineitem"), B.table(spark, folder, "orders")
    df = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_shipdate", "o_orderdate")
    profile = Profile(
        "shipping", columns=(ColumnSpec("l_shipdate", "datetime"), ColumnSpec("o_orderdate", "datetime")),
        rules=(CrossRule("shipped_after_order", "expression", "Lines ship after their order", 0.8,
                         expression="l_shipdate >= o_orderdate"),))
    return row_results(df, expression_rules(df, profile))


def _outliers(df: DataFrame, name: str, cut: float) -> DataFrame:
    profile = Profile("values", outlier_columns=(name,), outlier_cut=cut)
    rules = outlier_rules(df, fit_outliers(df, profile))
    counted = scored_rules(tally(df, rules), rules)
    return counted.select(
        "rule_id", "n_checked", "n_failed", F.round("score", 6).alias("score"),
        F.round(F.col("detail")["median"].cast("double"), 6).alias("median"),
        F.round(F.col("detail")["robust_scale"].cast("double"), 6).alias("robust_scale"),
        F.col("detail")["log_scaled"].alias("log_scaled"))


@query("robust_outliers")
def robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _outliers(B.table(spark, folder, "events"), "value", 4.0)


@query("robust_outliers_log")
def robust_outliers_log(spark: SparkSession, folder: str) -> DataFrame:
    df = B.table(spark, folder, "events").select((F.col("value") * F.col("value")).alias("squared"))
    return _outliers(df, "squared", 2.5)


@query("rule_results")
def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    return results(header_run(spark, folder).results)


@query("dimension_scores")
def dimension_scores(spark: SparkSession, folder: str) -> DataFrame:
    return dimension_table(header_run(spark, folder).results, B.HEADERS)


def _summary(run: QualityRun) -> DataFrame:
    df = quality_summary(run.results, run.profile, run.table, run.total_rows, run.n_columns)
    return rounded(df.drop("generated_at"))


@query("batch_quality_score")
def batch_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(header_run(spark, folder))


@query("lineitem_quality_score")
def lineitem_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    refs = {"orders": B.table(spark, folder, "orders"), "part": B.table(spark, folder, "part")}
    return _summary(QualityRun(B.table(spark, folder, "lineitem", position=True), B.LINEITEM, refs, today=B.TODAY))


# --- issue register ---------------------------------------------------------------------

ISSUE = ["issue_id", "priority", "severity", "severity_score", "source", "dimension", "rule_id", "scope", "table",
         "column", "n_records", "pct_affected", "reason", "recommended_action"]


def header_issues(spark: SparkSession, folder: str) -> DataFrame:
    run = header_run(spark, folder)
    return prioritized([quality_issues(run.results, B.HEADERS, "orders")])


@query("issue_register")
def issue_register(spark: SparkSession, folder: str) -> DataFrame:
    return header_issues(spark, folder).select(*ISSUE)


@query("issue_sample_keys")
def issue_sample_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = sample_keys(header_run(spark, folder).positioned_findings)
    return keys.select("rule_id", F.concat_ws(",", "record_keys").alias("record_keys"))


QUERIES["severity_counts"] = lambda s, d: severity_counts(header_issues(s, d))
QUERIES["top_issues"] = lambda s, d: top_issues(header_issues(s, d), 5)
QUERIES["issues_by_severity"] = lambda s, d: by_severity(header_issues(s, d), ["critical", "high"]).select(
    "priority", "rule_id", "severity")


@query("findings_per_rule")
def findings_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    return header_run(spark, folder).findings().groupBy("table", "rule_id", "dimension").agg(
        F.count(F.lit(1)).alias("n_findings"), F.countDistinct("row_key").alias("n_rows"))


def _price_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_identity(B.table(spark, folder, "orders", position=True), ["o_orderkey"], ["o_orderkey"])
    return rows.select("__position", ROW_KEY, F.col("o_totalprice").alias("score"))


@query("anomaly_issues")
def anomaly_issue_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders flagged by price under the review budget, listed one by one up to the register's cap."""
    scores = _price_scores(spark, folder)
    threshold = review_budget(scores)
    summary = anomaly_summary(scores, threshold.value, threshold.rule, "price")
    issues = prioritized([anomaly_issues(spark, scores, summary, "orders")])
    return issues.select(*ISSUE, F.concat_ws(",", "record_keys").alias("record_keys"))


@query("anomaly_summary")
def anomaly_summary_row(spark: SparkSession, folder: str) -> DataFrame:
    scores = _price_scores(spark, folder)
    threshold = review_budget(scores)
    s = anomaly_summary(scores, threshold.value, threshold.rule, "price")
    names = ["model", "n_scored", "n_flagged", "flag_rate", "threshold_value", "threshold_rule", "score_median",
             "score_max"]
    return rounded(small_table(
        spark, [tuple(s[n] for n in names)],
        "model string, n_scored bigint, n_flagged bigint, flag_rate double, threshold_value double, "
        "threshold_rule string, score_median double, score_max double"))


STRICT_LINES = Profile(
    "lineitem",
    columns=(ColumnSpec("l_orderkey", "int"), ColumnSpec("l_quantity", "float", max=45), ColumnSpec("l_discount", "float", max=0.08),
             ColumnSpec("l_returnflag", allowed_values=("A", "N")), ColumnSpec("l_shipmode", required=False)),
)


@query("findings_partitioned")
def findings_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """A table in partition folders without a key: every failing row keeps a position of its own."""
    path = scratch_path(spark)
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    B.table(spark, folder, "lineitem").select(*columns).write.partitionBy("l_returnflag").parquet(path)
    run = QualityRun(read_table(spark, path, "parquet", position=True), STRICT_LINES, today=B.TODAY)
    return run.positioned_findings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.countDistinct(POSITION).alias("n_positions"))


@query("csv_round_trip")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Parts written as CSV files and read back as a reference table: types found again, rows numbered without gaps per file."""
    path = scratch_path(spark)
    parts = B.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    write_tables({"part": parts.repartition(3)}, path)
    back = read_reference_dir(spark, path)["part"]
    file, row = F.floor(F.col(POSITION) / FILE_ROWS), F.col(POSITION) % FILE_ROWS
    numbered = back.withColumn("__file", file).withColumn("__row", row)
    gapless = numbered.groupBy("__file").agg((F.max("__row") + 1 == F.countDistinct("__row")).alias("gapless"))
    return numbered.join(gapless, "__file").select("p_partkey", "p_name", "p_brand", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"), "gapless")


@query("top_scored_rows")
def top_scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_identity(B.table(spark, folder, "orders", position=True), ["o_orderkey"], ["o_orderkey"])
    return top_scored(rows.drop("o_orderdate"), rows.select(POSITION, F.col("o_totalprice").alias("score")))


# --- reports ----------------------------------------------------------------------------


def _written_report(spark: SparkSession, folder: str) -> dict[str, str]:
    batch = B.dirty_headers(spark, folder)
    audit = audit_batch(batch, B.HEADERS, {"customer": B.table(spark, folder, "customer")}, table="orders", order=["o_orderkey"],
                        config=AuditConfig(use_model=False, today=B.TODAY), batch_id="orders-1")
    return write_report(audit, scratch_path(spark))


@query("report_document")
def report_document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON report of an audit, written and read again: head, scores per dimension, counts per severity."""
    doc = read_reports(spark, _written_report(spark, folder)["json"])
    rows = doc.select("batch_id", "table", "n_rows", "quality.n_columns", "quality.global_score", "quality.grade", "quality.profile_inferred", "n_issues",
                      F.explode("quality.dimensions").alias("dimension", "d"), "severity_counts")
    return rows.select("batch_id", "table", "n_rows", "n_columns", "global_score", "grade", "profile_inferred", "n_issues", "dimension", "d.*",
                       *[F.col("severity_counts")[level].alias(f"n_{level}") for level in ("critical", "high", "medium", "low")])


@query("report_issues")
def report_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The issues of a written report, from its JSON document."""
    doc = read_reports(spark, _written_report(spark, folder)["json"])
    return doc.select(F.explode("issues").alias("i")).select("i.issue_id", "i.priority", "i.severity", "i.severity_score", "i.rule_id", "i.n_records", "i.reason",
                                                             F.concat_ws(",", "i.record_keys").alias("record_keys"))


@query("report_top_issues")
def report_top_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The first issues, from the report's CSV register."""
    return read_top_issues(spark, _written_report(spark, folder)["issues"], 5)


@query("written_findings")
def written_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings of an audit, written in a folder per rule and read again."""
    audit = audit_batch(B.dirty_headers(spark, folder), B.HEADERS, {"customer": B.table(spark, folder, "customer")}, table="orders", order=["o_orderkey"],
                        config=AuditConfig(use_model=False, today=B.TODAY))
    found = spark.read.parquet(write_report(audit, scratch_path(spark), findings=True)["findings"])
    return findings_by_rule(found)


# --- profiles ---------------------------------------------------------------------------


@query("inferred_profile")
def inferred_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile_table(spark, infer_profile(B.table(spark, folder, "customer"))))


@query("inferred_profile_orders")
def inferred_profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile_table(spark, infer_profile(settled(B.dirty_headers(spark, folder)))))


@query("loaded_profile_scores")
def loaded_profile_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A profile written as JSON, read from the shared folder and applied."""
    raw = asdict(B.HEADERS)
    raw["cross_field_rules"], raw["dimension_weights"] = raw.pop("rules"), raw.pop("weights")
    path = f"{scratch_path(spark)}/orders.json"
    write_text(spark, path, json.dumps(raw))
    df = B.dirty_headers(spark, folder)
    return row_results(df, completeness_rules(df, load_profile(path, spark)))


@query("resolved_profiles")
def resolved_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Which profile a batch gets: the given one, a bundled one that fits its columns, or one inferred from its rows."""
    rows = []
    for case, df, given in (("given", B.table(spark, folder, "part"), B.PARTS), ("bundled", B.card_rows(spark, folder).drop(POSITION), None),
                            ("inferred", B.table(spark, folder, "customer"), None)):
        profile, notes = resolve_profile(df, given)
        rows.append((case, profile.name, profile.inferred, ",".join(profile.primary_key), len(profile.columns), len(notes), df.count()))
    return small_table(spark, rows, "case string, profile string, inferred boolean, primary_key string, n_columns bigint, n_notes bigint, n_rows bigint")


@query("detected_profile")
def detected_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.card_rows(spark, folder).drop("__position")
    found = detect_profile(rows, bundled_profiles())
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(found.name if found else None).alias("profile"), "n_rows")


@query("card_quality_score")
def card_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    """The bundled card profile, found by the schema, over card-shaped rows."""
    rows = B.card_rows(spark, folder)
    return _summary(QualityRun(rows, detect_profile(rows, bundled_profiles())))


# --- defects and their detection --------------------------------------------------------


def _injected(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return inject_defects(B.clean_tables(spark, folder), B.SPECS, B.SEED, B.KEYS, B.TODAY)


def measured(spark: SparkSession, folder: str) -> Measurement:
    return measure_rules(B.clean_tables(spark, folder), B.PROFILES, B.SPECS, B.SEED, B.KEYS, B.TODAY)


@query("injected_ledger")
def injected_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _injected(spark, folder)[1]


@query("dirty_table")
def dirty_table(spark: SparkSession, folder: str) -> DataFrame:
    df = _injected(spark, folder)[0]["orders"]
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("changed_cells")
def changed_cell_rows(spark: SparkSession, folder: str) -> DataFrame:
    dirty, _ = _injected(spark, folder)
    return changed_cells(B.table(spark, folder, "part"), dirty["part"], "p_partkey")


QUERIES["defect_recall"] = lambda s, d: measured(s, d).recall()
QUERIES["rule_precision"] = lambda s, d: measured(s, d).precision()
QUERIES["engine_summary"] = lambda s, d: measured(s, d).summary()


@query("dirty_quality_scores")
def dirty_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measured(spark, folder).scores().drop("generated_at"), 4)


# --- features, thresholds, metrics ------------------------------------------------------


@query("feature_matrix")
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.card_rows(spark, folder)
    return rounded(rows.select("vec_id", *[c.alias(n) for n, c in card_features().items()]))


@query("scaler_parameters")
def scaler_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on the normal rows only."""
    scaler = Scaler.fit(normals(B.card_rows(spark, folder), "Class"), card_features())
    rows = list(zip(scaler.names, scaler.means, scaler.deviations))
    return rounded(small_table(spark, rows, "feature string, mean double, deviation double"))


@query("temporal_split_counts")
def temporal_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = temporal_split(B.table(spark, folder, "events"), "ts", "event_id")
    return union([
        p.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
              F.sum("user_id").alias("user_sum")).withColumn("part", F.lit(n))
        for n, p in zip(("train", "calibration", "test"), parts)])


@query("review_budget_threshold")
def review_budget_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(review_budget(B.scored_orders(spark, folder)).as_row(spark))


@query("train_percentile_threshold")
def train_percentile_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(train_percentile(B.scored_orders(spark, folder)).as_row(spark))


@query("best_f1_threshold")
def best_f1_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(best_f1(B.scored_orders(spark, folder)).as_row(spark))


QUERIES["pr_curve"] = lambda s, d: rounded(metrics.pr_curve(B.scored_orders(s, d)))


@query("average_precision")
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(B.scored_documents(spark, folder)).select(
        "n_records", "n_positives", "prevalence", "pr_auc", "pr_auc_lift"))


@query("roc_auc")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(B.scored_orders(spark, folder)).select("n_records", "roc_auc"))


CONFUSION = ["true_positives", "false_positives", "false_negatives", "true_negatives", "alerts", "flag_rate",
             "precision", "recall", "f1"]


@query("confusion_metrics")
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_orders(spark, folder)
    return rounded(metrics.confusion(scored, review_budget(scored, 0.05).value).select(*CONFUSION))


@query("reviewer_workload")
def reviewer_workload(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_orders(spark, folder)
    return rounded(metrics.confusion(scored, review_budget(scored, 0.05).value).select(
        "alerts", "review_hours", "false_positives_per_true_positive", "review_hours_per_fraud_found",
        "alerts_per_1000_records"))


@query("caught_positives")
def caught_positives(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_orders(spark, folder)
    return caught(flagged(scored, review_budget(scored).value))


@query("precision_at_k")
def precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_orders(spark, folder)
    size = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    return rounded(metrics.precision_at_k(scored, size["n"], size["p"], tie="o_orderkey"))


@query("budget_sweep")
def budget_sweep(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_orders(spark, folder)
    return rounded(metrics.budget_sweep(scored, review_budgets(scored, BUDGET_SWEEP)).select(
        "threshold_name", "budget", "threshold_value", *CONFUSION))


def _models(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Three rankings of the same orders: by price, by cheapness, and at random."""
    scored = B.scored_orders(spark, folder)
    draw = uniform(F.col("o_orderkey"), "random", 42)
    return {"price": scored, "cheapness": scored.withColumn("score", -F.col("score")),
            "random": scored.withColumn("score", draw)}


def _compared(models: dict[str, DataFrame], oracle: bool = False) -> DataFrame:
    return metrics.comparison({
        n: metrics.evaluate_scores(s, best_f1(s) if oracle else review_budget(s), tie="o_orderkey")
        for n, s in models.items()})


QUERIES["model_comparison"] = lambda s, d: rounded(_compared(_models(s, d)))


@query("oracle_overstatement")
def oracle_overstatement(spark: SparkSession, folder: str) -> DataFrame:
    models = _models(spark, folder)
    return rounded(metrics.overstatement(_compared(models), _compared(models, oracle=True)))


QUERIES["score_histogram"] = lambda s, d: metrics.score_histogram(B.scored_orders(s, d))


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_documents(spark, folder)
    threshold = review_budget(scored, 0.1).value
    return rounded(metrics.bootstrap_interval(scored, threshold, F.col("doc_id")))


@query("bootstrap_replicates")
def bootstrap_replicates(spark: SparkSession, folder: str) -> DataFrame:
    scored = B.scored_documents(spark, folder)
    return rounded(metrics.bootstrap_replicates(scored, 2000.0, F.col("doc_id")))


# --- looking at labelled data -----------------------------------------------------------


def _labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    return B.table(spark, folder, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES["class_counts"] = lambda s, d: rounded(explore.class_counts(_labelled_lines(s, d), "returned"))
QUERIES["missing_totals"] = lambda s, d: explore.missing_totals(B.dirty_headers(s, d))
QUERIES["class_separation"] = lambda s, d: rounded(
    explore.class_separation(_labelled_lines(s, d), "returned", NUMBERS))
QUERIES["deviation_spread"] = lambda s, d: rounded(explore.deviation_spread(B.table(s, d, "lineitem"), NUMBERS), 4)


@query("class_describe")
def class_describe(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents by length."""
    df = B.scored_documents(spark, folder)
    return rounded(explore.class_describe(df, "label", "score"), 4)


@query("hour_density")
def hour_density(spark: SparkSession, folder: str) -> DataFrame:
    df = B.table(spark, folder, "events").withColumn("is_error", (F.col("event_type") == "error").cast("int"))
    hour = F.hour("ts") + F.minute("ts") / 60
    return rounded(explore.hour_density(df, hour, "is_error"))


# --- sources ----------------------------------------------------------------------------


@query("most_recent_rows")
def most_recent_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = B.table(spark, folder, "events")
    return most_recent(df, "ts", 500, "event_id").select("event_id", "user_id", "event_type", "value")


@query("recent_sample")
def recent_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The latest rows, written as a sample and read again."""
    path = scratch_path(spark)
    write_recent_sample(B.table(spark, folder, "events"), path, "ts", 500, "event_id")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "value")


@query("source_contract")
def source_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled source is accepted when its size and positives are as stated."""
    df = B.table(spark, folder, "labels").withColumn("toxic", F.concat(F.lit("'"), "toxic", F.lit("'")))
    stated = B.table(spark, folder, "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    accepted = checked_contract(df, Contract(stated["n"], 3, "toxic", stated["p"]))
    return accepted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


# --- detectors --------------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    df = with_identity(B.table(spark, folder, "lineitem", position=True), None)
    features = plain_features(df, NUMBERS)
    return Scaler.fit(df, features).transform(df, features)


def _scores(df: DataFrame) -> DataFrame:
    return df.select(ROW_KEY, F.round("score", 6).alias("score")).withColumnRenamed(ROW_KEY, "row_key")


def _card_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_identity(B.card_rows(spark, folder), ["vec_id"])
    features = card_features()
    return Scaler.fit(normals(rows, "Class"), features).transform(rows, features, ["Class"])


def _sign_model(names: int = 31, kept: int = 12) -> AutoencoderModel:
    """A network with set weights: it passes the positive part of its first features on and drops the rest."""
    config = AutoencoderConfig(hidden=(), latent=kept)
    shares = np.eye(names, kept)
    flat = np.concatenate([shares.ravel(), np.zeros(kept), shares.T.ravel(), np.zeros(names)])
    return AutoencoderModel(flat, names, config)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Card-shaped rows under a key that two rows share."""
    return B.card_rows(spark, folder).withColumn("pair", F.floor(F.col("vec_id") / 2))


@query("explained_issues")
def explained_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged rows and why, by a saved model with set weights that the audit loads from its folder."""
    rows, path = _pairs(spark, folder), scratch_path(spark)
    features = card_features()
    scaler = Scaler(tuple(features), (0.0,) * len(features), (0.25,) * len(features))
    save_bundle(spark, ModelBundle(scaler, _sign_model()), path)
    audit = audit_batch(rows, bundle=path, order=["pair"], table="cards", config=AuditConfig(review_budget=0.02, today=B.TODAY))
    found = audit.issues.filter("source = 'anomaly_model'")
    top = F.from_json("evidence", "top_features array<struct<feature: string, observed: double, expected: double>>")["top_features"]
    return found.select("issue_id", "rule_id", "n_records", F.concat_ws(",", "record_keys").alias("record_keys"),
                        F.concat_ws(",", F.transform(top, lambda f: f["feature"])).alias("features"), "reason")


@query("model_round_trip")
def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Trained detectors, saved twice and loaded: each row's scores are those of the models that were saved."""
    df, path = _card_features(spark, folder), scratch_path(spark)
    short = AutoencoderConfig(max_epochs=5, batch_size=256)
    scaler = Scaler.fit(normals(B.card_rows(spark, folder), "Class"), card_features())
    ae, forest = fit_autoencoder(df, 31, short), fit_forest(df, ForestConfig(trees=20))
    saved = ae.score(df).select(F.lit("autoencoder").alias("model"), "score")
    save_bundle(spark, ModelBundle(scaler, ae), path)
    save_bundle(spark, ModelBundle(scaler, ae, forest, saved), path)
    back = load_bundle(spark, path)
    both = df.select(F.col(ROW_KEY).alias("row_key"), FEATURES)
    for name, before, after in (("autoencoder", ae, back.autoencoder), ("forest", forest, back.forest)):
        both = before.score(both).withColumnRenamed("score", "a")
        both = after.score(both).withColumn(f"same_{name}", F.col("a") == F.col("score")).drop("a", "score")
    counted = calibration_scores(back, "autoencoder").agg(F.count("score").alias("n_calibration"))
    return both.drop(FEATURES).withColumn("same_scaler", F.lit(back.scaler == scaler)).crossJoin(F.broadcast(counted))  # one row on the right


def _vector_features(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """All components of the embeddings, scaled by the normal rows."""
    df = with_identity(B.table(spark, folder, "embeddings", position=True), ["vec_id"])
    width = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = df.withColumn("Class", (F.col("label") == 0).cast("int"))
    features = {f"e{i}": F.col("embedding")[i].cast("double") for i in range(width)}
    return Scaler.fit(normals(rows, "Class"), features).transform(rows, features, ["Class"]), width


@query("anomaly_pca_scores")
def anomaly_pca_scores(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = _vector_features(spark, folder)
    return _scores(fit_pca(normals(df, "Class")).score(df))


@query("pca_facts")
def pca_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What makes the fitted directions principal components: unit length, and cov(feature, projection) = eigenvalue * weight."""
    df, width = _vector_features(spark, folder)
    rows = normals(df, "Class")
    weights = fit_pca(rows).components
    k = weights.shape[1]
    z = [F.aggregate(F.zip_with(F.col(FEATURES), F.array(*[F.lit(float(v)) for v in weights[:, j]]), lambda x, w: x.cast("double") * w),
                     F.lit(0.0), lambda a, v: a + v).alias(f"z{j}") for j in range(k)]
    cells = rows.select(*z, F.posexplode(FEATURES).alias("f", "x"))
    covariances = [r.asDict() for r in cells.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[
        F.covar_samp(F.col("x").cast("double"), f"z{j}").alias(f"c{j}") for j in range(k)]).collect()]  # a row per feature
    c = np.array([[r[f"c{j}"] for j in range(k)] for r in sorted(covariances, key=lambda r: r["f"])])
    values = (c * weights).sum(axis=0)
    gram = weights.T @ weights
    facts = [(j + 1, covariances[0]["n"], bool(abs(gram[j, j] - 1) < 1e-9), bool(np.abs(np.delete(gram[j], j)).max() < 1e-9),
              bool(np.abs(c[:, j] - values[j] * weights[:, j]).max() < 1e-9 * values[0]), bool(j == 0 or values[j] <= values[j - 1] * (1 + 1e-12)))
             for j in range(k)]
    return small_table(spark, facts, "component int, n bigint, unit boolean, orthogonal boolean, solves boolean, falling boolean")


@query("anomaly_forest_scores")
def anomaly_forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = _lines(spark, folder)
    return _scores(fit_forest(df, FOREST).score(df))


@query("anomaly_autoencoder_scores")
def anomaly_autoencoder_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = _lines(spark, folder)
    return _scores(fit_autoencoder(df, len(NUMBERS), AUTOENCODER).score(df))


@query("autoencoder_explanations")
def autoencoder_explanations(spark: SparkSession, folder: str) -> DataFrame:
    df, width = _vector_features(spark, folder)
    model = fit_autoencoder(normals(df, "Class"), width, AUTOENCODER)
    return model.explain(df).select(
        F.col(ROW_KEY).alias("row_key"), F.round("score", 6).alias("score"),
        F.round(F.array_max("errors"), 6).alias("largest_error"))


@query("fallback_forest")
def fallback_forest(spark: SparkSession, folder: str) -> DataFrame:
    df = with_identity(B.table(spark, folder, "orders", position=True), ["o_orderkey"])
    scored = score_with_fallback(df, 0.005, FOREST)
    return _scores(scored.scores)


@query("logistic_ceiling")
def logistic_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = _vector_features(spark, folder)
    return _scores(fit_logistic(df, "Class").score(df))


@query("logistic_facts")
def logistic_facts(spark: SparkSession, folder: str) -> DataFrame:
    """At the optimum the weighted gradient of the penalized loss vanishes; both classes weigh the same in total."""
    df, width = _vector_features(spark, folder)
    model = fit_logistic(df, "Class")
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.sum("Class").cast("bigint").alias("p")).first()
    weight = F.when(F.col("Class") == 1, sizes["n"] / (2 * sizes["p"])).otherwise(sizes["n"] / (2 * (sizes["n"] - sizes["p"])))
    off = model.score(df).select(FEATURES, "Class", (weight * (F.col("score") - F.col("Class"))).alias("off"), weight.alias("w"))
    sums = off.agg(F.sum("off").alias("intercept"), F.sum(F.when(F.col("Class") == 1, F.col("w"))).alias("heavy"), F.sum("w").alias("all"), *[
        F.sum(F.col("off") * F.col(FEATURES)[i]).alias(f"g{i}") for i in range(width)]).first()
    slope = np.array([sums[f"g{i}"] for i in range(width)]) + model.model.coefficients.toArray()
    size = np.abs(np.array([*slope, sums["intercept"]])).max() / sizes["n"]
    return small_table(spark, [(sizes["n"], sizes["p"], bool(size < 1e-4), bool(abs(sums["heavy"] / sums["all"] - 0.5) < 1e-9))],
                       "n bigint, positives bigint, gradient_vanishes boolean, classes_balanced boolean")


def _set_trees() -> ForestModel:
    """Three trees of two levels over the line numbers, with set cuts and path lengths."""
    feature = np.array([[t, (t + 1) % 4, (t + 2) % 4, 0, 0, 0, 0] for t in range(3)], np.int16)
    cuts = (25.0, 30_000.0, 0.05, 0.04)
    threshold = np.array([[cuts[f] for f in row[:3]] + [0.0] * 4 for row in feature])
    path = np.array([[0, 0, 0, 2 + t, 3, 4, 5 + t] for t in range(3)], np.float32)
    return ForestModel(feature, threshold, path, 256, 2)


@query("set_forest_scores")
def set_forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Lines scored by trees that are set, not grown, so that every path is known."""
    df = B.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col(c).cast("float") for c in NUMBERS]).alias(FEATURES))
    scored = _set_trees().score(df)
    return scored.groupBy(F.round("score", 9).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("forest_facts")
def forest_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every tree drew the stated number of rows, cuts inside the data, and shorter or equal paths than its rows allow."""
    df = _lines(spark, folder)
    rows = df.count()
    ends = df.agg(*[m(F.col(FEATURES)[i].cast("double")).alias(f"{label}{i}") for i in range(len(NUMBERS)) for label, m in (("a", F.min), ("b", F.max))]).first()
    samples, size = tree_samples(df, FOREST, rows)
    drawn = {r["tree"]: r["n"] for r in samples.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per tree
    model = fit_forest(df, FOREST, rows)
    low, high = (np.array([ends[f"{e}{i}"] for i in range(len(NUMBERS))]) for e in "ab")
    facts = []
    for t in range(len(model.feature)):
        inner = model.feature[t][:2 ** model.depth - 1]
        cut = model.threshold[t][:2 ** model.depth - 1]
        used = np.isfinite(cut) & (cut != 0)
        inside = (cut >= low[inner]) & (cut <= high[inner])
        leaves = model.path[t][2 ** model.depth - 1:]
        facts.append((t, size, drawn.get(t, 0) >= size, bool(inside[used].all()), bool((leaves > 0).all() and (leaves <= model.depth + float(mean_path(size))).all())))
    return small_table(spark, facts, "tree int, sample bigint, drawn boolean, cuts_inside boolean, paths_bounded boolean")


@query("autoencoder_facts")
def autoencoder_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A fit repeats whatever the layout, and learns."""
    df, width = _vector_features(spark, folder)
    short = AutoencoderConfig(max_epochs=15, batch_size=256, workers=3)
    models = [fit_autoencoder(df.repartition(n, F.col(ROW_KEY)), width, short) for n in (2, 5)]
    epochs = models[0].history
    return small_table(spark, [(bool(np.array_equal(models[0].flat, models[1].flat)), bool(epochs[-1][1] < epochs[0][1]), len(models[0].flat))],
                       "same boolean, learns boolean, weights bigint")


@query("full_audit")
def full_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One batch from rules to register, with record-level anomalies."""
    audit = audit_batch(B.dirty_headers(spark, folder), B.HEADERS, {"customer": B.table(spark, folder, "customer")},
                        config=AuditConfig(forest=FOREST, today=B.TODAY), table="orders", order=["o_orderkey"])
    return audit.issues.select(*ISSUE)
