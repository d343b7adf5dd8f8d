import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from assayer.operators.quality import QualityRun
from assayer.operators.rules import RESULT_SCHEMA
from assayer.operators.scoring import dimension_scores, quality_summary
from assayer.plans.profile import ColumnSpec as C, Profile
from assayer.session import small_table


def results(spark, scores, rule="r", failed=1):
    return small_table(spark, [(f"{rule}.{d}", d, None, "", 10, failed, s, 0.5, 1.0, {}) for d, s in scores.items()],
                       RESULT_SCHEMA)


def summary(spark, scores, **kw):
    return quality_summary(results(spark, scores, **kw), Profile("t"), "t", 10, 3).first()


def test_geometric_mean_punishes_one_dead_dimension(spark):
    row = summary(spark, {"completeness": 1.0, "validity": 1.0, "consistency": 1.0, "uniqueness": 0.0,
                          "plausibility": 1.0})
    assert row["global_score_arithmetic"] == pytest.approx(85.0)
    assert row["global_score"] < 55 and row["grade"] == "F"


def test_clean_batch(tiny, tiny_profile):
    run = QualityRun(tiny, tiny_profile)
    row = quality_summary(run.results, tiny_profile, "tiny", run.total_rows, run.n_columns).first()
    assert (row["global_score"], row["grade"], row["n_rows"], row["n_columns"]) == (pytest.approx(100.0), "A", 40, 5)


@pytest.mark.parametrize("score, grade", [(0.95, "A"), (0.85, "B"), (0.75, "C"), (0.65, "D"), (0.55, "F")])
def test_bands(spark, score, grade):
    assert summary(spark, {"validity": score})["grade"] == grade


def test_collapsed_dimension_caps_at_d(spark):
    row = summary(spark, {"completeness": 1.0, "validity": 1.0, "consistency": 1.0, "uniqueness": 1.0,
                          "plausibility": 0.49})
    assert row["global_score"] > 80 and row["grade"] == "D"


def test_broken_key_is_f(tiny, tiny_profile):
    df = tiny.unionByName(tiny.limit(1).withColumn("__position", F.lit(40).cast("bigint")))
    run = QualityRun(df, tiny_profile)
    row = quality_summary(run.results, tiny_profile, "tiny", 41, 5).first()
    assert row["grade"] == "F" and row["global_score"] > 90


def test_dimension_without_rules_has_no_weight(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    run = QualityRun(df, Profile("t", columns=(C("v", "float"),)))
    weights = {r["dimension"]: r["weight"] for r in dimension_scores(run.results, run.profile).collect()}
    assert weights["consistency"] == 0.0 and weights["plausibility"] == 0.0 and weights["validity"] == 0.25


def test_quality_does_not_import_detectors():
    code = ("import sys; sys.path.insert(0, %r); import assayer.operators.quality, assayer.operators.scoring; "
            "assert not [m for m in sys.modules if m.startswith('assayer.operators.') and "
            "m.rsplit('.', 1)[1] in ('forest', 'reconstruct', 'supervised', 'features')]")
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code % root], check=True)
