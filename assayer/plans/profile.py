"""Expectation profiles: what a table should look like, checked before any job starts.

Operators P-VALIDATE, P-EXPRCHECK and P-DETECT.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from assayer.functions.predicates import check_predicate
from assayer.session import read_text

# Dimensions, in report order, with their default weights.
DIMENSION_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.25,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "plausibility": 0.15,
}
DIMENSIONS = tuple(DIMENSION_WEIGHTS)
DTYPES = ("int", "float", "string", "datetime", "bool")
RULE_KINDS = ("expression", "foreign_key", "lookup_match", "group_total")
OUTLIER_CUT = 4.0


class ProfileError(ValueError):
    """A profile is malformed."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str = "string"
    required: bool = True
    max_null_rate: float = 0.0
    min: float | None = None
    max: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    allowed_values: tuple[str, ...] | None = None
    regex: str | None = None
    unique: bool = False
    weight: float = 1.0
    description: str = ""

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ProfileError(f"column {self.name}: unknown dtype {self.dtype!r}")
        if not self.weight > 0:
            raise ProfileError(f"column {self.name}: weight must be positive")
        for bound in ("min", "max"):
            if getattr(self, bound) is not None:
                object.__setattr__(self, bound, float(getattr(self, bound)))
        if self.allowed_values is not None:
            object.__setattr__(self, "allowed_values", tuple(str(v) for v in self.allowed_values))


@dataclass(frozen=True)
class CrossRule:
    """A rule across columns or tables.

    ``group_total`` compares ``column`` with the rounded sum of ``ref_column``
    over the rows of ``ref_table`` whose ``ref_key`` equals ``local_key``.
    """

    id: str
    kind: str
    description: str = ""
    impact: float = 0.8
    expression: str | None = None
    column: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    ref_key: str | None = None
    local_key: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in RULE_KINDS:
            raise ProfileError(f"rule {self.id}: unknown kind {self.kind!r}")
        if not 0.0 <= self.impact <= 1.0:
            raise ProfileError(f"rule {self.id}: impact must lie in [0, 1]")
        needed = ["expression"] if self.kind == "expression" else ["column", "ref_table", "ref_column"]
        if self.kind in ("lookup_match", "group_total"):
            needed += ["local_key", "ref_key"]
        absent = [n for n in needed if not getattr(self, n)]
        if absent:
            raise ProfileError(f"rule {self.id}: {self.kind} needs {absent}")


@dataclass(frozen=True)
class Profile:
    name: str
    primary_key: tuple[str, ...] = ()
    columns: tuple[ColumnSpec, ...] = ()
    rules: tuple[CrossRule, ...] = ()
    outlier_columns: tuple[str, ...] = ()
    outlier_cut: float = OUTLIER_CUT
    weights: dict[str, float] = field(default_factory=lambda: dict(DIMENSION_WEIGHTS))
    description: str = ""
    inferred: bool = False

    def __post_init__(self) -> None:
        for name in ("primary_key", "columns", "rules", "outlier_columns"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        unknown = sorted(set(self.weights) - set(DIMENSIONS))
        if unknown:
            raise ProfileError(f"profile {self.name}: unknown dimensions {unknown}")

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def checked(self) -> "Profile":
        """Compile every expression rule once; needs an active session, starts no job."""
        for rule in self.rules:
            if rule.kind == "expression":
                check_predicate(rule.expression or "", set(self.column_names), rule.id)
        return self

    def with_(self, **changes: Any) -> "Profile":
        return replace(self, **changes)


def _only_known(kind: type, raw: dict[str, Any], label: str) -> dict[str, Any]:
    known = {f.name for f in fields(kind)}
    extra = sorted(set(raw) - known)
    if extra:
        raise ProfileError(f"{label}: unknown fields {extra}")
    return raw


# Names used in profile files for fields that are called differently here.
FILE_NAMES = {"cross_field_rules": "rules", "dimension_weights": "weights"}


def profile_from_dict(raw: dict[str, Any]) -> Profile:
    body = {FILE_NAMES.get(k, k): v for k, v in raw.items() if v is not None}
    label = f"profile {body.get('name', '?')}"
    if "name" not in body:
        raise ProfileError(f"{label}: a name is required")
    body["columns"] = [ColumnSpec(**_only_known(ColumnSpec, c, label)) for c in body.get("columns", [])]
    body["rules"] = [CrossRule(**_only_known(CrossRule, r, label)) for r in body.get("rules", [])]
    return Profile(**_only_known(Profile, body, label)).checked()


def load_profile(path: str | Path, spark: SparkSession | None = None) -> Profile:
    """Read a profile from YAML or JSON; with a session from any file system it reaches."""
    text = Path(path).read_text(encoding="utf-8") if spark is None else read_text(spark, str(path))
    if str(path).endswith(".json"):
        return profile_from_dict(json.loads(text))
    import yaml

    return profile_from_dict(yaml.safe_load(text))


def detect_profile(df: DataFrame, profiles: list[Profile], min_overlap: float = 0.9) -> Profile | None:
    """The profile with the largest share of its required columns present; the first one wins a tie.

    Reads the schema only.
    """
    def share(profile: Profile) -> float:
        required = {c.name for c in profile.columns if c.required}
        return len(required & set(df.columns)) / len(required) if required else 0.0

    ranked = sorted(profiles, key=share, reverse=True)  # keeps the given order among equals
    return next((p for p in ranked if share(p) >= max(min_overlap, 1e-9)), None)
