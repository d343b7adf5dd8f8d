"""How a failure becomes a severity, and what to do about it: the shipped values, and settings that replace them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from assayer.session import read_text

# Fixed values, down to TRUNCATED_SCORE.

LEVELS = ("critical", "high", "medium", "low")
BANDS = ((75.0, "critical"), (50.0, "high"), (25.0, "medium"))
IMPACT_SHARE = 0.45
EXTENT_SHARE = 0.30
CONFIDENCE_SHARE = 0.25
LEAST_WEIGHT = 0.2
UNKNOWN_DIMENSION_WEIGHT = 0.1
STATISTICAL_CONFIDENCE = 0.6
ANOMALY_IMPACT = 0.60
PASSING_SCORE = 0.999
SAMPLE_KEYS = 10
MAX_RECORD_ISSUES = 200
ALWAYS_CRITICAL = ("expect_primary_key_to_be_unique",)

# Advice by rule family: the part of a rule id before the first dot.
FAMILY_ACTIONS = {
    "expect_column_to_exist":
        "Restore the missing column in the extract, or update the expectation profile if the schema change was "
        "intentional.",
    "expect_column_values_to_not_be_null":
        "Trace the null rows back to the source system and make the field mandatory at entry; quarantine affected "
        "records until the value is supplied.",
    "expect_column_values_to_be_of_type":
        "Fix the export locale or column typing at the source; values arriving as text will not aggregate and will "
        "silently drop out of downstream sums.",
    "expect_column_values_to_be_between":
        "Reject the out-of-range values at ingestion and add a bounds check to the source form; review whether a "
        "sign or unit error is involved.",
    "expect_column_dates_to_be_between":
        "Investigate the date entries outside the plausible window; these usually indicate a manual typo or a "
        "timezone/format conversion fault.",
    "expect_column_values_to_be_in_set":
        "Map the free-text variants onto the controlled vocabulary and lock the field down to a picklist at the "
        "source.",
    "expect_column_values_to_match_regex":
        "Correct the malformed identifiers; a format breach here breaks joins against every downstream master table.",
    "expect_table_rows_to_be_unique":
        "De-duplicate the batch and add a load-level uniqueness constraint; repeated rows will double-count in "
        "every aggregate.",
    "expect_primary_key_to_be_unique":
        "Stop the load. A duplicated key makes the batch unusable for any join or aggregation until the conflicting "
        "records are reconciled.",
    "expect_column_values_to_be_unique":
        "Reconcile the duplicated values before they are used as a join key.",
    "consistency":
        "Reconcile the related fields; one of them is wrong and downstream logic cannot tell which.",
    "expect_column_values_to_be_plausible":
        "Review the flagged values manually. These are statistical outliers, not confirmed errors, and some will be "
        "legitimate extremes.",
    "anomaly":
        "Route to manual review. The record is unlike the transactions the model was trained on; confirm it before "
        "it is processed automatically.",
}

# Advice for single consistency rules, by the id after "consistency.".
RULE_ACTIONS = {
    "net_value_matches_quantity_times_price":
        "Recompute net value from quantity times unit price, or correct whichever of the three fields was "
        "mis-keyed. Invoice matching will fail on these lines.",
    "material_id_exists_in_material_master":
        "Create the missing material master records or correct the references; these lines cannot be received or "
        "invoiced as they stand.",
    "po_id_exists_in_purchase_orders":
        "Restore the missing purchase order headers; these orphan lines will be dropped by any header-driven report.",
    "uom_matches_material_master":
        "Align the line unit of measure with the material master, or convert the quantity. A unit mismatch silently "
        "corrupts every quantity aggregate.",
    "delivery_date_after_order_date":
        "Correct the delivery dates that precede their order date; lead-time and on-time-delivery metrics are "
        "unusable for these orders.",
    "vendor_id_exists_in_vendor_master":
        "Create or correct the vendor master records before the payment run.",
    "receipt_not_greater_than_order":
        "Investigate over-delivery: either the receipt was posted against the wrong line or the order quantity was "
        "reduced after the fact.",
    "invoice_not_greater_than_receipt":
        "Block the invoice. Quantity invoiced exceeds quantity received, which is the classic over-billing pattern.",
}

TRUNCATED_ACTION = (
    "Increase the register cap or tighten the review budget to bring the alert volume within review capacity."
)
TRUNCATED_SCORE = 40.0


@dataclass(frozen=True)
class Severity:
    """Settings of the register; what is not given keeps its shipped value."""

    bands: dict[str, float] = field(default_factory=lambda: {level: low for low, level in BANDS})
    weights: dict[str, float] = field(default_factory=lambda: {
        "impact": IMPACT_SHARE, "extent": EXTENT_SHARE, "confidence": CONFIDENCE_SHARE})
    always_critical: tuple[str, ...] = ALWAYS_CRITICAL
    actions: dict[str, str] = field(default_factory=lambda: dict(FAMILY_ACTIONS))
    rule_actions: dict[str, str] = field(default_factory=lambda: dict(RULE_ACTIONS))

    def __post_init__(self) -> None:
        unknown = sorted(set(self.bands) - set(LEVELS[:-1])) + sorted(set(self.weights) - {"impact", "extent", "confidence"})
        if unknown:
            raise ValueError(f"severity settings: unknown names {unknown}")
        if len(self.weights) != 3 or min(self.weights.values()) < 0:
            raise ValueError("severity settings: impact, extent and confidence need a weight of zero or more")
        object.__setattr__(self, "always_critical", tuple(self.always_critical))

    def ordered_bands(self) -> list[tuple[float, str]]:
        return sorted(((float(low), level) for level, low in self.bands.items()), reverse=True)


def severity_from_dict(raw: dict[str, Any]) -> Severity:
    extra = sorted(set(raw) - set(Severity.__dataclass_fields__))
    if extra:
        raise ValueError(f"severity settings: unknown fields {extra}")
    return Severity(**{k: v for k, v in raw.items() if v is not None})


def load_severity(path: str | Path, spark: SparkSession | None = None) -> Severity:
    """Read settings from YAML or JSON; with a session from any file system it reaches."""
    text = Path(path).read_text(encoding="utf-8") if spark is None else read_text(spark, str(path))
    if str(path).endswith(".json"):
        return severity_from_dict(json.loads(text))
    import yaml

    return severity_from_dict(yaml.safe_load(text))


SHIPPED = Severity()
