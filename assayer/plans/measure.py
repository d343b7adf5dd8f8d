"""Corrupt tables, audit them with their profiles, and measure the rules against the ledger."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from assayer.operators.defects import DEFAULT_SPECS, DefectSpec, PRIMARY_KEYS, inject_defects
from assayer.operators.evaluation import all_findings, defect_recall, engine_summary, rule_precision
from assayer.operators.identity import with_position
from assayer.operators.quality import QualityRun
from assayer.operators.scoring import quality_summary
from assayer.plans.profile import Profile
from assayer.session import settled


@dataclass
class Measurement:
    dirty: dict[str, DataFrame]
    ledger: DataFrame
    runs: dict[str, QualityRun]

    @cached_property
    def findings(self) -> DataFrame:
        """Written once: recall, precision and summary all read them."""
        return settled(all_findings([r.findings() for r in self.runs.values()]))

    def recall(self) -> DataFrame:
        return defect_recall(self.ledger, self.findings)

    def precision(self) -> DataFrame:
        return rule_precision(self.ledger, self.findings)

    def summary(self) -> DataFrame:
        return engine_summary(self.recall(), self.precision())

    def scores(self) -> DataFrame:
        rows = [quality_summary(r.results, r.profile, t, r.total_rows, r.n_columns) for t, r in self.runs.items()]
        return all_findings(rows)


def measure_rules(
    tables: dict[str, DataFrame], profiles: dict[str, Profile],
    specs: tuple[DefectSpec, ...] = DEFAULT_SPECS, seed: int = 1337,
    keys: dict[str, str] | None = None, today: str | None = None,
) -> Measurement:
    """The dirty tables also serve as reference tables, and are written once for all rules."""
    dirty, ledger = inject_defects(tables, specs, seed, keys or PRIMARY_KEYS, today)
    changed = {s.table for s in specs}
    dirty = {n: with_position(df) if n in changed else df for n, df in dirty.items()}
    runs = {t: QualityRun(dirty[t], p, dirty, t, today) for t, p in profiles.items()}
    return Measurement(dirty, settled(ledger), runs)
