"""Train the detectors on a time-ordered split and compare them (the whole of section 3.2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import column
from assayer.operators.features import FEATURES, Scaler, normals, random_scores, temporal_split
from assayer.operators.forest import ForestConfig, fit_forest
from assayer.operators.identity import POSITION, ROW_KEY
from assayer.operators.metrics import (
    RESAMPLES, bootstrap_interval, budget_sweep, comparison, evaluate_scores, overstatement,
)
from assayer.operators.reconstruct import AutoencoderConfig, fit_autoencoder, fit_pca
from assayer.operators.supervised import fit_logistic
from assayer.operators.thresholds import (
    BUDGET_SWEEP, REVIEW_BUDGET, Threshold, best_f1, review_budget, review_budgets, train_percentile,
)
from assayer.session import settled
from assayer.sources.models import ModelBundle


@dataclass(frozen=True)
class TrainConfig:
    shares: tuple[float, float] = (0.6, 0.2)
    autoencoder: AutoencoderConfig = AutoencoderConfig()
    forest: ForestConfig = ForestConfig()
    pca_components: int = 8
    budget: float = REVIEW_BUDGET
    sweep: tuple[float, ...] = BUDGET_SWEEP
    resamples: int = RESAMPLES
    seed: int = 42


@dataclass
class Comparison:
    bundle: ModelBundle
    table: DataFrame
    oracle: DataFrame
    sweeps: dict[str, DataFrame]
    intervals: dict[str, DataFrame]
    train_percentile_demo: DataFrame
    scores: dict[str, DataFrame]
    thresholds: dict[str, Threshold] = field(default_factory=dict)

    def overstatement(self) -> DataFrame:
        return overstatement(self.table, self.oracle)


def train_and_compare(
    rows: DataFrame, features: dict[str, Column], label: str, time: str, tie: str, config: TrainConfig = TrainConfig()
) -> Comparison:
    """``rows`` carries identity columns, the label, a time and a unique number to order equal times."""
    rows = rows.withColumn("label", column(label).cast("int"))
    train, calibration, test = temporal_split(rows, time, tie, config.shares)
    scaler = Scaler.fit(normals(train), features)
    # each window is read by every model
    fit_all, cal, tst = (settled(scaler.transform(w, features, ["label"])) for w in (train, calibration, test))
    fit_normal = normals(fit_all)
    width = len(features)
    ae = fit_autoencoder(fit_normal, width, config.autoencoder)
    forest = fit_forest(fit_normal, config.forest)
    models = {
        "Autoencoder (trained on normals)": ae,
        "Autoencoder (fully unsupervised)": fit_autoencoder(fit_all, width, config.autoencoder),
        "Isolation Forest (trained on normals)": forest,
        "Isolation Forest (fully unsupervised)": fit_forest(fit_all, config.forest),
        "PCA reconstruction (trained on normals)": fit_pca(fit_normal, min(config.pca_components, width)),
        "Logistic Regression (supervised ceiling)": fit_logistic(fit_all),
    }
    identity = [POSITION, ROW_KEY, "label"]
    scored = {n: (m.score(cal), m.score(tst)) for n, m in models.items()}
    scored["Random (floor)"] = tuple(random_scores(w, F.col(ROW_KEY), config.seed) for w in (cal, tst))
    metrics, best, sweeps, intervals, scores, thresholds = {}, {}, {}, {}, {}, {}
    for name, (on_cal, on_test) in scored.items():
        on_cal = settled(on_cal.select(*identity, "score"))
        scores[name] = settled(on_test.select(*identity, "score"))
        thresholds[name] = review_budget(on_cal, config.budget)
        metrics[name] = evaluate_scores(scores[name], thresholds[name])
        best[name] = evaluate_scores(scores[name], best_f1(scores[name]))
        sweeps[name] = budget_sweep(scores[name], review_budgets(on_cal, config.sweep))
        intervals[name] = bootstrap_interval(scores[name], thresholds[name].value, F.col(ROW_KEY), config.resamples,
                                             config.seed)
    main = "Autoencoder (trained on normals)"
    demo = evaluate_scores(scores[main], train_percentile(ae.score(fit_normal), 99.0))
    saved = ae.score(cal).select(F.lit("autoencoder").alias("model"), "score").unionByName(
        forest.score(cal).select(F.lit("isolation_forest").alias("model"), "score"))
    return Comparison(
        ModelBundle(scaler, ae, forest, settled(saved)), comparison(metrics), comparison(best), sweeps, intervals,
        demo, scores, thresholds)
