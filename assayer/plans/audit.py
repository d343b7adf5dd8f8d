"""The audit of one batch: quality, anomalies and one issue register (S-SCORE, A-FALLBACK, A-BUNDLE, I-REPORT)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.coerce import column, is_number_type, missing
from assayer.operators.consistency import Reference, ambiguous_references
from assayer.operators.features import CARD_COLUMNS, FEATURES, card_features
from assayer.operators.forest import ForestConfig, fit_forest
from assayer.operators.identity import POSITION, ROW_KEY, with_position
from assayer.operators.issues import (
    anomaly_issues, anomaly_summary, flagged_records, prioritized, quality_issues, sample_keys, severity_counts,
    top_features,
)
from assayer.operators.order_stats import quantiles
from assayer.operators.quality import QualityRun
from assayer.operators.reconstruct import Reconstruction
from assayer.operators.scoring import dimension_table, quality_summary
from assayer.operators.thresholds import REVIEW_BUDGET, Threshold, caught, flagged, review_budget
from assayer.plans.inference import resolve_profile
from assayer.plans.profile import Profile
from assayer.plans.severity import MAX_RECORD_ISSUES, SHIPPED, Severity
from assayer.session import settled
from assayer.sources.models import ModelBundle, calibration_scores, load_bundle

MIN_FALLBACK_ROWS = 50
MIN_FALLBACK_COLUMNS = 2
MIN_COVERAGE = 0.5


@dataclass(frozen=True)
class AuditConfig:
    review_budget: float = REVIEW_BUDGET
    max_record_issues: int = MAX_RECORD_ISSUES
    use_model: bool = True
    fallback_forest: bool = True
    forest: ForestConfig = ForestConfig()
    today: str | None = None
    severity: Severity = SHIPPED


@dataclass
class Audit:
    """The outcome of one audit; tables stay in Spark."""

    batch_id: str
    table: str
    quality: QualityRun
    summary: DataFrame
    dimensions: DataFrame
    issues: DataFrame
    anomaly: dict[str, Any] = field(default_factory=dict)
    scores: DataFrame | None = None
    threshold: Threshold | None = None
    notes: list[str] = field(default_factory=list)

    @property
    def results(self) -> DataFrame:
        return self.quality.results

    @property
    def profile(self) -> Profile:
        return self.quality.profile

    def severity_counts(self) -> DataFrame:
        return severity_counts(self.issues)


@dataclass
class _Scored:
    """Scores of one batch and how they came about."""

    model_name: str
    scores: DataFrame
    threshold: Threshold
    features: DataFrame | None = None
    model: Reconstruction | None = None
    names: tuple[str, ...] = ()


def _score_with_bundle(rows: DataFrame, bundle: ModelBundle, budget: float, label: list[str]) -> _Scored:
    features = bundle.scaler.transform(rows, card_features(), label)
    scores = settled(bundle.autoencoder.score(features).drop(FEATURES))
    reference = calibration_scores(bundle, "autoencoder")
    threshold = review_budget(scores if reference is None else reference, budget)
    return _Scored("autoencoder", scores, threshold, features, bundle.autoencoder, bundle.scaler.names)


def fallback_features(rows: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]] | None:
    """Numeric columns with enough values, gaps filled by the median; nothing when there is too little."""
    names = [f.name for f in rows.schema.fields if is_number_type(f.dataType) and f.name not in (POSITION, ROW_KEY)]
    if len(names) < MIN_FALLBACK_COLUMNS:
        return None
    present = rows.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(~missing(column(n), rows.schema[n].dataType)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    kept = {n: present[f"n{i}"] for i, n in enumerate(names) if present[f"n{i}"] > MIN_COVERAGE * present["rows"]}
    if len(kept) < MIN_FALLBACK_COLUMNS or present["rows"] < MIN_FALLBACK_ROWS:
        return None
    gaps = [n for n, count in kept.items() if count < present["rows"]]

    def number(n: str):
        return F.when(~missing(column(n), rows.schema[n].dataType), column(n).cast("double"))

    medians = quantiles(rows.select(*[number(n).alias(f"v{i}") for i, n in enumerate(gaps)]),
                        {f"v{i}": [0.5] for i in range(len(gaps))},
                        {f"v{i}": kept[n] for i, n in enumerate(gaps)})
    fill = {n: medians[f"v{i}"][0] for i, n in enumerate(gaps)}
    values = F.array(*[F.coalesce(number(n), F.lit(fill.get(n))) for n in kept])
    return rows.select(POSITION, ROW_KEY, *(keep or []), values.alias(FEATURES)), list(kept)


def score_with_fallback(
    rows: DataFrame, budget: float, forest: ForestConfig, keep: list[str] | None = None
) -> _Scored | None:
    """A forest fitted on the batch itself: it finds rows unlike the rest of this batch."""
    prepared = fallback_features(rows, keep)
    if prepared is None:
        return None
    features, names = prepared
    model = fit_forest(features, forest)
    scores = settled(model.score(features).drop(FEATURES))
    return _Scored("isolation_forest_fitted_on_batch", scores, review_budget(scores, budget), names=tuple(names))


def _explanations(scored: _Scored, limit: int) -> DataFrame | None:
    """Features that stand out in the rows which the register lists, by position."""
    if scored.model is None or scored.features is None:
        return None
    top = flagged_records(scored.scores, scored.threshold.value, limit).select(POSITION)
    rows = scored.features.join(F.broadcast(top), POSITION, "left_semi")  # at most ``limit`` rows
    return scored.model.explain(rows).select(POSITION, top_features(list(scored.names)).alias("top_features"))


def audit_batch(
    df: DataFrame,
    profile: Profile | None = None,
    references: dict[str, DataFrame | Reference] | None = None,
    bundle: ModelBundle | str | None = None,
    config: AuditConfig = AuditConfig(),
    batch_id: str | None = None,
    table: str | None = None,
    label: str | None = None,
    order: list[str] | None = None,
) -> Audit:
    """Check a batch against its profile, score its rows, and rank what was found.

    ``bundle`` is a trained model or the folder of one; a folder without a usable model
    is noted, and the batch is scored by a model of its own.
    """
    profile, notes = resolve_profile(df, profile, table or "uploaded_batch")
    df = with_position(df)  # one fixed copy for all passes, unless the source is one
    table = table or profile.name
    run = QualityRun(df, profile, references or {}, table, config.today, order)
    notes += ambiguous_references(df, profile, run.refs)
    parts = [quality_issues(run.results, profile, table, sample_keys(run.positioned_findings), config.severity)]
    anomaly: dict[str, Any] = {}
    scored: _Scored | None = None
    if config.use_model:
        scored = _detect(run, _loaded(df.sparkSession, bundle, notes), config, label, notes)
    if scored is not None:
        value = scored.threshold.value
        anomaly = anomaly_summary(scored.scores, value, scored.threshold.rule, scored.model_name)
        parts.append(anomaly_issues(df.sparkSession, scored.scores, anomaly, table, config.max_record_issues,
                                    _explanations(scored, config.max_record_issues), config.severity))
        if label and label in df.columns:
            labelled = flagged(scored.scores.withColumn("label", column(label).try_cast("double")), value)
            anomaly |= caught(labelled).first().asDict()
    # the register is bounded by rules and record cap; settle it so that all readers see one evaluation
    issues = settled(prioritized(parts))
    return Audit(
        batch_id or datetime.now(timezone.utc).strftime("batch-%Y%m%dT%H%M%S"), table, run,
        quality_summary(run.results, profile, table, run.total_rows, run.n_columns),
        dimension_table(run.results, profile), issues, anomaly,
        flagged(scored.scores, scored.threshold.value) if scored else None,
        scored.threshold if scored else None, notes)


def _loaded(spark: SparkSession, bundle: ModelBundle | str | None, notes: list[str]) -> ModelBundle | None:
    if not isinstance(bundle, str):
        return bundle
    try:
        return load_bundle(spark, bundle)
    except Exception as error:  # an unusable model must not block an audit
        notes.append(f"Trained model could not be loaded: {error}")
        return None


def _detect(
    run: QualityRun, bundle: ModelBundle | None, config: AuditConfig, label: str | None, notes: list[str]
) -> _Scored | None:
    keep = [label] if label and label in run.batch.columns else []
    if bundle is not None:
        if set(CARD_COLUMNS) <= set(run.batch.columns):
            return _score_with_bundle(run.rows, bundle, config.review_budget, keep)
        notes.append("The trained autoencoder expects the credit card transaction schema; this batch does not match it.")
    if not config.fallback_forest:
        return None
    scored = score_with_fallback(run.rows, config.review_budget, config.forest, keep)
    if scored is not None:
        notes.append("Anomaly scores come from an Isolation Forest fitted on this batch, not from a trained model.")
    return scored
