import json

import pytest
from pyspark.sql import functions as F

from assayer.operators.issues import (
    ISSUE_SCHEMA, anomaly_issues, anomaly_summary, by_severity, flagged_records, prioritized, quality_issues,
    severity_band, severity_counts, severity_score, top_features, with_percentiles,
)
from assayer.operators.features import COMPONENTS, Scaler, card_features
from assayer.operators.forest import ForestConfig
from assayer.operators.reconstruct import AutoencoderConfig, fit_autoencoder
from assayer.operators.identity import with_identity
from assayer.operators.rules import RESULT_SCHEMA
from assayer.plans.audit import AuditConfig, audit_batch
from assayer.plans.bundled import po_lines
from assayer.plans.profile import Profile
from assayer.session import small_table
from assayer.sources import reports
from assayer.sources.models import ModelBundle
from assayer.sources.reports import read_top_issues, report_document, write_report

FOREST = ForestConfig(trees=20, sample=128)


def issue(rule, score, n=1, key="k"):
    return (f"ISS-{rule}", "low", score, "quality_rule", "validity", rule, "column", "t", None, n, 0.1, "r", "a", [key], "{}")


def test_bands_and_always_critical(spark):
    df = spark.createDataFrame([(80.0, "x"), (75.0, "x"), (60.0, "x"), (30.0, "x"), (10.0, "x"),
                                (1.0, "expect_primary_key_to_be_unique")], "s double, r string")
    got = [r[0] for r in df.select(severity_band(F.col("s"), F.col("r"))).collect()]
    assert got == ["critical", "critical", "high", "medium", "low", "critical"]


def test_severity_grows_with_the_root_of_extent(spark):
    def score(n, weight=1.0):
        one = F.lit(1.0)
        return spark.range(1).select(severity_score(F.lit(0.5), F.lit(n), F.lit(10_000), F.lit(weight), 1.0, one)).first()[0]

    assert score(400) - score(0) == pytest.approx(2 * (score(100) - score(0)))
    assert score(0) == pytest.approx(100 * (0.225 + 0.25))
    assert score(100, 0.01) == pytest.approx(0.2 * score(100))


def test_priority_is_dense_and_settled_by_rule_and_key(spark):
    df = small_table(spark, [issue("a", 10.0), issue("b", 90.0), issue("c", 50.0), issue("c", 50.0, key="a"),
                             issue("b2", 50.0), issue("d", 50.0, n=9)], ISSUE_SCHEMA)
    got = [(r["rule_id"], r["record_keys"][0]) for r in prioritized([df]).orderBy("priority").collect()]
    assert got == [("b", "k"), ("d", "k"), ("b2", "k"), ("c", "a"), ("c", "k"), ("a", "k")]
    counts = {r["severity"]: r["n_issues"] for r in severity_counts(df).collect()}
    assert counts == {"critical": 0, "high": 0, "medium": 0, "low": 6}
    assert by_severity(df, ["high"]).count() == 0


def test_rare_failures_raise_no_issue_and_ids_have_gaps(spark):
    rows = [("a.x", "plausibility", "x", "d", 10_000, 5, 0.9995, 0.35, 1.0, {}),
            ("b.x", "validity", "x", "d", 10_000, 500, 0.95, 0.7, 1.0, {"k": "v"}),
            ("c", "completeness", None, "d", 100, 4, 1.0, 0.9, 1.0, {})]
    got = quality_issues(small_table(spark, rows, RESULT_SCHEMA), Profile("t"), "t").collect()
    assert [r["issue_id"] for r in got] == ["ISS-Q0002"]
    assert got[0]["reason"] == "d. 500 of 10,000 rows checked failed (5.00%)."
    assert json.loads(got[0]["evidence"]) == {"rule_score": "0.95", "k": "v"}


def test_register_cap(spark):
    df = spark.range(1000).select(F.col("id").alias("__position"), F.col("id").cast("string").alias("__row_key"),
                                  F.when(F.col("id") < 40, 5.0).otherwise(F.col("id") / 1000).alias("score"))
    summary = anomaly_summary(df, 2.0, "rule", "m")
    assert summary["n_flagged"] == 40 and summary["score_max"] == 5.0
    issues = anomaly_issues(spark, df, summary, "t", 5).collect()
    assert len(issues) == 6 and issues[-1]["n_records"] == 35 and issues[-1]["severity"] == "medium"
    assert [i["record_keys"] for i in issues[:5]] == [["0"], ["1"], ["2"], ["3"], ["4"]]
    top = with_percentiles(flagged_records(df, 2.0, 5), df, 1000).collect()
    assert [r["percentile"] for r in top] == pytest.approx([(960 + 20.5) / 1000] * 5)
    assert issues[0]["reason"] == "Anomaly score 5 (98.0500% percentile, 9.3x the batch median)."
    assert json.loads(issues[0]["evidence"])["threshold"] == 2.0
    none = anomaly_issues(spark, df, anomaly_summary(df, 99.0, "rule", "m"), "t", 5)
    assert none.count() == 0 and none.columns == df.sparkSession.createDataFrame([], ISSUE_SCHEMA).columns


def test_rows_that_share_a_key_keep_their_own_explanation(spark):
    df = spark.createDataFrame([(i, "same", float(i)) for i in range(4)], "__position bigint, __row_key string, score double")
    why = spark.range(4).select(F.col("id").alias("__position"), F.array(F.lit(4.0), F.col("id").cast("double")).alias("errors"),
                                F.array(F.lit(0.0), F.lit(1.0)).alias("observed"), F.array(F.lit(2.0), F.lit(3.0)).alias("expected"))
    issues = anomaly_issues(spark, df, anomaly_summary(df, 2.0, "rule", "m"), "t", 9,
                            why.select("__position", top_features(["a", "b"]).alias("top_features"))).collect()
    shares = [json.loads(i["evidence"])["top_features"][0]["share_of_error"] for i in issues]
    assert shares == pytest.approx([4 / 7, 4 / 6]) and all(i["record_keys"] == ["same"] for i in issues)
    assert issues[0]["reason"].endswith("Largest deviations: a (observed 0.00 vs expected 2.00), b (observed 1.00 vs expected 3.00).")


def test_percentiles_match_average_ranks(spark):
    import pandas as pd
    values = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "__position bigint, score double")
    top = flagged_records(df, 0.0, 5)
    expected = sorted(pd.Series(values).rank(pct=True), reverse=True)[:5]
    assert sorted((r["percentile"] for r in with_percentiles(top, df, 7).collect()), reverse=True) == pytest.approx(expected)


def test_top_features(spark):
    row = spark.createDataFrame([([1.0, 4.0, 0.0, 5.0], [0.0] * 4, [1.0] * 4)],
                                "errors array<double>, observed array<double>, expected array<double>")
    got = row.select(top_features(["a", "b", "c", "d"])).first()[0]
    assert [f["feature"] for f in got] == ["d", "b", "a"] and got[0]["share_of_error"] == 0.5


def test_sample_keys_are_first_ten_in_order(tiny, tiny_profile):
    df = tiny.withColumn("category", F.when(F.col("__position") >= 12, "z").otherwise(F.col("category")))
    audit = audit_batch(df, tiny_profile, config=AuditConfig(use_model=False))
    row = audit.issues.filter("rule_id like '%in_set%'").first()
    assert row["record_keys"] == [f"R-{i:03d}" for i in range(13, 23)] and row["n_records"] == 28


def test_unknown_schema_is_inferred(spark):
    df = spark.range(200).select(F.concat(F.lit("T"), "id").alias("ticket"), (F.col("id") * 1.5).alias("amount_local"),
                                 F.when(F.col("id") % 2 == 0, "web").otherwise("branch").alias("channel"))
    audit = audit_batch(df)
    assert audit.profile.inferred and any("inferred" in n for n in audit.notes) and audit.scores is None
    assert audit.batch_id.startswith("batch-") and audit.anomaly == {}


def test_audit_of_lines_writes_a_report(spark, erp, tmp_path):
    bad = F.col("position") == 20
    lines = erp["po_lines"].withColumn("uom", F.when(bad, "XX").otherwise(F.col("uom"))).withColumn(
        "fraud", (F.col("position") == 10).cast("int"))
    audit = audit_batch(lines, None, erp, config=AuditConfig(forest=FOREST, max_record_issues=3), table="po_lines",
                        label="fraud", order=["po_line_id"])
    assert audit.profile == po_lines()
    rules = {r["rule_id"] for r in audit.issues.collect()}
    assert {"expect_column_values_to_be_in_set.uom", "consistency.uom_matches_material_master"} <= rules
    assert any("Isolation Forest" in n for n in audit.notes)
    assert audit.anomaly["n_flagged"] == audit.scores.filter("flag").count() >= 7
    assert audit.anomaly["n_labelled_positives"] == 300
    folder = str(tmp_path / "report")
    paths = write_report(audit, folder, findings=True)
    document = json.loads((tmp_path / "report" / "report.json").read_text())
    assert document["schema_version"] == "1.0" and document["n_issues"] == audit.issues.count()
    assert sum(document["severity_counts"].values()) == document["n_issues"]
    text = (tmp_path / "report" / "report.md").read_text()
    assert "# Data quality report - po_lines" in text and "`consistency.uom_matches_material_master`" in text
    top = read_top_issues(spark, paths["issues"], 3)
    assert [r["priority"] for r in top.collect()] == [1, 2, 3]
    assert top.columns == ["priority", "severity", "dimension", "rule_id", "n_records", "reason"]
    found = spark.read.parquet(paths["findings"]).groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in found} == {
        r["rule_id"]: r["n_failed"] for r in audit.results.collect() if r["n_failed"]}
    assert report_document(audit)["quality"]["grade"] == document["quality"]["grade"]


def test_audit_with_trained_model(spark, erp):
    df = small_card(spark)
    rows = with_identity(df, None)
    scaler = Scaler.fit(rows.filter("Time <> 300"), card_features())
    model = fit_autoencoder(scaler.transform(rows, card_features()), 31, AutoencoderConfig(max_epochs=3, batch_size=64))
    bundle = ModelBundle(scaler, model)
    audit = audit_batch(df, bundle=bundle, config=AuditConfig(review_budget=0.01))
    assert audit.profile.name == "creditcard_transactions" and audit.anomaly["model"] == "autoencoder"
    first = audit.issues.filter("source = 'anomaly_model'").orderBy("priority").first()
    assert first["record_keys"] == ["5"] and "Largest deviations: " in first["reason"]
    assert len(json.loads(first["evidence"])["top_features"]) == 3
    other = audit_batch(erp["vendors"], bundle=bundle)
    assert any("does not match" in n for n in other.notes)


def small_card(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 28))
    v[5] += 30
    rows = [(i, i * 60.0, i % 17 + 1.0, *map(float, v[i])) for i in range(300)]
    return spark.createDataFrame(rows, "__position bigint, Time double, Amount double, "
                                 + ", ".join(f"{c} double" for c in COMPONENTS))


def test_a_model_folder_is_whole_or_noted(spark, tmp_path):
    from assayer.operators.reconstruct import AutoencoderModel
    from assayer.sources.models import ModelDamaged, ModelMissing, bundle_available, load_bundle, save_bundle
    import numpy as np

    config = AutoencoderConfig(hidden=(), latent=2)
    scaler = Scaler(tuple(card_features()), (0.0,) * 31, (1.0,) * 31)

    def model(x):
        return ModelBundle(scaler, AutoencoderModel(np.full(31 * 2 * 2 + 33, x), 31, config))

    folder = str(tmp_path / "models")
    with pytest.raises(ModelMissing):
        load_bundle(spark, folder)
    first = save_bundle(spark, model(0.5), folder)
    second = save_bundle(spark, model(0.25), folder)
    assert first != second and load_bundle(spark, folder).autoencoder.flat[0] == 0.25
    (tmp_path / "models" / "version-000002" / "manifest.json").unlink()  # a save that did not finish
    assert bundle_available(spark, folder) and load_bundle(spark, folder).autoencoder.flat[0] == 0.5
    third = save_bundle(spark, model(0.125), folder)
    assert third.endswith("version-000003")
    manifest = tmp_path / "models" / "version-000003" / "manifest.json"
    manifest.with_name(".manifest.json.crc").unlink()  # the file system's own check would see the change first
    manifest.write_text(manifest.read_text().replace('"digest": "', '"digest": "0'))
    with pytest.raises(ModelDamaged):
        load_bundle(spark, folder)
    quick = AuditConfig(forest=FOREST, review_budget=0.01)
    audit = audit_batch(small_card(spark), bundle=folder, config=quick)
    assert any(n.startswith("Trained model could not be loaded: ") for n in audit.notes)
    assert audit.anomaly["model"] == "isolation_forest_fitted_on_batch"
    manifest.unlink()
    assert audit_batch(small_card(spark), bundle=folder, config=quick).anomaly["model"] == "autoencoder"


def test_top_scored_rows(spark):
    from assayer.operators.issues import top_scored
    rows = spark.range(30).select(F.col("id").alias("__position"), (F.col("id") % 4).alias("score"), (F.col("id") * 2).alias("score_of"), F.lit("k").alias("__row_key"))
    top = top_scored(rows.drop("score"), rows.select("__position", "score"), 9)
    assert top.columns == ["anomaly_score", "score_of"]
    assert [tuple(r) for r in top.collect()] == [(3, 2 * i) for i in range(3, 30, 4)] + [(2, 4), (2, 12)]


def test_profile_from_a_file_system(spark, tmp_path):
    from assayer.plans.profile import load_profile
    path = tmp_path / "p.json"
    path.write_text('{"name": "t", "columns": [{"name": "a", "dtype": "int"}]}')
    assert load_profile(f"file://{path}", spark).columns[0].name == "a"


def test_severity_settings_from_a_file(spark, tmp_path, tiny, tiny_profile):
    from assayer.plans.severity import Severity, load_severity, severity_from_dict
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"bands": {"critical": 99, "high": 10, "medium": 5}, "always_critical": ["expect_column_values_to_be_in_set"],
                                "weights": {"impact": 1.0, "extent": 0.0, "confidence": 0.0}, "actions": {"expect_column_values_to_be_between": "Look."}}))
    df = tiny.withColumn("category", F.when(F.col("__position") == 3, "Z").otherwise(F.col("category"))).withColumn(
        "quantity", F.when(F.col("__position") == 5, -1.0).otherwise(F.col("quantity")))
    for settings in (load_severity(path), load_severity(f"file://{path}", spark)):
        audit = audit_batch(df, tiny_profile, config=AuditConfig(use_model=False, severity=settings))
        got = {r["rule_id"]: (r["severity"], r["severity_score"], r["recommended_action"]) for r in audit.issues.collect()}
        assert got["expect_column_values_to_be_in_set.category"][0] == "critical"
        assert got["expect_column_values_to_be_between.quantity"] == ("high", 75.0, "Look.")
        assert got["expect_column_values_to_be_in_set.category"][2] == AuditConfig().severity.actions["anomaly"]
    assert Severity().ordered_bands() == [(75.0, "critical"), (50.0, "high"), (25.0, "medium")]
    for wrong in ({"band": {}}, {"bands": {"worst": 1}}, {"weights": {"impact": 1.0}}):
        with pytest.raises(ValueError):
            severity_from_dict(wrong)


def test_written_findings_are_counted_in_bounded_tasks(spark, monkeypatch):
    found = spark.range(60, numPartitions=1).select(F.concat(F.lit("r"), F.col("id") % 2).alias("rule_id"), F.col("id").cast("string").alias("row_key"))
    found = found.unionByName(found.limit(10))
    monkeypatch.setattr(reports, "FINDINGS_PER_TASK", 10)
    counted = reports.findings_by_rule(found)
    assert ", 7), REPARTITION" in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == [("r0", 35, 30), ("r1", 35, 30)]
