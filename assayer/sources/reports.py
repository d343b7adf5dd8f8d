"""Reports of an audit: IO-REPORT, I-DICT, I-MD, IO-METRICS, IO-TOPISSUES.

The register, the rule results and the scores per dimension are bounded, so the
two documents are put together on the driver; findings are written by Spark.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.issues import top_issues
from assayer.plans.audit import Audit
from assayer.session import write_text

SCHEMA_VERSION = "1.0"
TOP_ISSUES = 25
#: Keys of findings that one task counts at a time.
FINDINGS_PER_TASK = 1 << 19


def _issues(audit: Audit) -> list[dict[str, Any]]:
    rows = [r.asDict() for r in audit.issues.orderBy("priority").collect()]
    for r in rows:
        r["evidence"] = json.loads(r["evidence"] or "{}")
        r["detected_at"] = r["detected_at"].isoformat()
    return rows


def report_document(audit: Audit) -> dict[str, Any]:
    """The whole report as one document."""
    quality = audit.summary.first().asDict()
    issues = _issues(audit)
    counts = {r["severity"]: r["n_issues"] for r in audit.severity_counts().collect()}
    quality["generated_at"] = quality["generated_at"].isoformat()
    for name in ("global_score", "global_score_arithmetic"):
        quality[name] = round(quality[name], 2)
    quality["dimensions"] = {
        r["dimension"]: {"score": r["score"], "weight": r["weight"], "rules_evaluated": r["rules"],
                         "rules_failed": r["failed_rules"]} for r in audit.dimensions.collect()}
    return {
        "schema_version": SCHEMA_VERSION, "batch_id": audit.batch_id, "table": audit.table,
        "n_rows": quality["n_rows"], "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "quality": quality, "anomaly": audit.anomaly, "severity_counts": counts, "n_issues": len(issues),
        "issues": issues, "notes": audit.notes,
    }


def _table(head: list[str], align: list[str], rows: list[list[str]]) -> list[str]:
    lines = [head, align, *rows]
    return ["| " + " | ".join(cells) + " |" for cells in lines]


def report_markdown(audit: Audit, document: dict[str, Any] | None = None, top: int = TOP_ISSUES) -> str:
    """The report as Markdown: scores, anomalies, first issues, all rules."""
    doc = document or report_document(audit)
    quality, counts, issues = doc["quality"], doc["severity_counts"], doc["issues"]
    origin = "inferred from the batch" if quality["profile_inferred"] else "curated expectation suite"
    lines = [
        f"# Data quality report - {doc['table']}", "",
        f"- **Batch**: `{doc['batch_id']}`",
        f"- **Rows**: {doc['n_rows']:,}  |  **Columns**: {quality['n_columns']}",
        f"- **Generated**: {doc['generated_at']}",
        f"- **Profile**: {origin}", "",
        "## Quality score", "",
        f"**{quality['global_score']:.1f} / 100 (grade {quality['grade']})**", "",
        f"Weighted geometric mean of the dimensions; the arithmetic mean is "
        f"{quality['global_score_arithmetic']:.1f}.", "",
        *_table(["Dimension", "Score", "Weight", "Rules", "Failed"], ["---", "---:", "---:", "---:", "---:"],
                [[n, f"{d['score']:.1f}", f"{d['weight']:.2f}", str(d["rules_evaluated"]), str(d["rules_failed"])]
                 for n, d in quality["dimensions"].items()]),
    ]
    a = doc["anomaly"]
    if a:
        lines += ["", "## Anomaly detection", "", f"- Model: **{a['model']}**",
                  f"- Records flagged: **{a['n_flagged']:,}** ({a['flag_rate']:.2%} of the batch)",
                  f"- Threshold: {a['threshold_value']:.6g} ({a['threshold_rule']})"]
        if a.get("n_labelled_positives") is not None:
            lines.append(f"- Known positives in batch: {a['n_labelled_positives']}, of which {a['n_caught']} "
                         "were flagged")
    lines += ["", "## Issues", "",
              f"{len(issues)} open issues: " + ", ".join(f"{counts[s]} {s}" for s in counts) + ".", "",
              f"### Top {min(top, len(issues))} by priority", "",
              *_table(["#", "Severity", "Dimension", "Rule", "Records", "Reason", "Recommended action"],
                      ["---:", "---", "---", "---", "---:", "---", "---"],
                      [[str(i["priority"]), i["severity"], i["dimension"], f"`{i['rule_id']}`",
                        f"{i['n_records']:,}", i["reason"].replace("|", "/"),
                        i["recommended_action"].replace("|", "/")] for i in issues[:top]]),
              "", "## All rules evaluated", "",
              *_table(["Rule", "Dimension", "Checked", "Failed", "Score"], ["---", "---", "---:", "---:", "---:"],
                      [[f"`{r['rule_id']}`", r["dimension"], f"{r['n_checked']:,}", f"{r['n_failed']:,}",
                        f"{r['score']:.4f}"] for r in audit.results.orderBy("dimension", "rule_id").collect()])]
    return "\n".join(lines) + "\n"


def write_report(audit: Audit, folder: str, top: int = TOP_ISSUES, findings: bool = False) -> dict[str, str]:
    """report.json, report.md and issues.csv; on request also all findings, by rule."""
    spark = audit.issues.sparkSession
    document = report_document(audit)
    paths = {"json": f"{folder}/report.json", "markdown": f"{folder}/report.md", "issues": f"{folder}/issues.csv"}
    write_text(spark, paths["json"], json.dumps(document, indent=2, default=str))
    write_text(spark, paths["markdown"], report_markdown(audit, document, top))
    flat = audit.issues.orderBy("priority").withColumn("record_keys", F.to_json("record_keys"))
    write_metrics(flat, paths["issues"])
    if findings:
        paths["findings"] = f"{folder}/findings"
        audit.quality.findings().write.mode("overwrite").partitionBy("rule_id").parquet(paths["findings"])
    return paths


def findings_by_rule(found: DataFrame) -> DataFrame:
    """Findings and flagged rows per rule, of written findings.

    Keys of findings pack so well that one split holds many millions of them, and counting distinct keys where they are read would hold them all.
    So they are dealt out first, to tasks whose number follows from the rows; a task holds about ``FINDINGS_PER_TASK`` keys at any size.
    """
    tasks = max(1, -(-found.count() // FINDINGS_PER_TASK))
    dealt = found.select("rule_id", "row_key").repartition(tasks, "rule_id", "row_key")
    keys = dealt.groupBy("rule_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("rule_id").agg(F.sum("n").alias("n_findings"), F.count("row_key").alias("n_rows"))


def write_metrics(table: DataFrame, path: str) -> None:
    """A small result table as CSV with a header, in one part."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_top_issues(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first issues of a written register."""
    issues = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return top_issues(issues.withColumn("priority", F.col("priority").cast("int")), n)


_DIMENSION = "struct<score: double, weight: double, rules_evaluated: bigint, rules_failed: bigint>"
#: What a written report holds, as far as readers of it rely on.
REPORT_SCHEMA = f"""schema_version string, batch_id string, `table` string, n_rows bigint, generated_at string,
  quality struct<`table`: string, n_rows: bigint, n_columns: bigint, global_score: double, global_score_arithmetic: double, grade: string,
    profile_inferred: boolean, dimensions: map<string, {_DIMENSION}>>,
  severity_counts map<string, bigint>, n_issues bigint,
  issues array<struct<issue_id: string, priority: bigint, severity: string, severity_score: double, rule_id: string, n_records: bigint,
    reason: string, record_keys: array<string>>>,
  notes array<string>"""


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Written reports as rows, one per document; a glob reads the reports of many batches."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
