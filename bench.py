"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from assayer.operators.features import Scaler, card_features  # noqa: E402
from assayer.operators.identity import with_identity  # noqa: E402
from assayer.operators.reconstruct import fit_autoencoder  # noqa: E402
from assayer.plans.train import train_and_compare  # noqa: E402
from assayer.session import local_session, settled  # noqa: E402
from workload.bindings import card_rows, table  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "lineitem_quality_score", "rule_results", "issue_register", "findings_per_rule", "lineitem_key_collisions",
    "ship_before_order", "header_totals", "robust_outliers", "inferred_profile_orders", "injected_ledger",
    "defect_recall", "temporal_split_counts", "pr_curve", "roc_auc", "best_f1_threshold", "precision_at_k",
    "model_comparison", "bootstrap_interval", "class_separation", "anomaly_pca_scores", "anomaly_forest_scores",
    "anomaly_autoencoder_scores", "fallback_forest", "logistic_ceiling", "full_audit",
]
#: Rows and features of the published autoencoder fit.
FIT_ROWS, FIT_WIDTH = 170_524, 31


def autoencoder_fit(spark, folder: str) -> DataFrame:
    """The published fit's size: lines with 31 features made of their numbers, at full settings; one row of what came out."""
    lines = table(spark, folder, "lineitem", position=True).limit(FIT_ROWS)
    base = [F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")]
    features = {f"f{i}": base[i % 8] * (1 + i // 8) + F.sin(base[(i + 3) % 8] * (i + 1)) for i in range(FIT_WIDTH)}
    rows = settled(Scaler.fit(lines, features).transform(lines, features))
    model = fit_autoencoder(rows, FIT_WIDTH)
    return model.score(rows).agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("error"))


def train_and_compare_card(spark, folder: str) -> DataFrame:
    """The whole training step on card-shaped rows: six detectors, thresholds, metrics, intervals."""
    rows = with_identity(card_rows(spark, folder), ["vec_id"])
    return train_and_compare(rows, card_features(), "Class", "Time", "vec_id").table


EXTRA = {"autoencoder_fit_170524x31": autoencoder_fit, "train_and_compare": train_and_compare_card}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "assayer-bench")
    QUERIES["class_counts"](spark, folder).collect()  # start the engine before the clock
    times = {}
    for name, body in ({n: QUERIES[n] for n in HEADLINE} | EXTRA).items():
        start = time.perf_counter()
        body(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
