"""Q-RUNALL and the findings of D-FINDINGS: every rule family over one batch."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.consistency import Reference, as_references, reference_entries
from assayer.operators.groups import Entry, findings, group_counts, verdicts
from assayer.operators.identity import POSITION, data_columns, with_identity
from assayer.operators.plausibility import OutlierFit, fit_outliers, outlier_rules
from assayer.operators.rules import (
    FINDING_COLUMNS, RESULT_SCHEMA, Rule, RowRule, completeness_rules, expression_rules, rule_results, tally, validity_rules,
)
from assayer.operators.uniqueness import equal_rows, row_duplicate_counts, row_duplicate_findings, row_rule, uniqueness_entries
from assayer.plans.profile import Profile
from assayer.session import small_table


@dataclass
class QualityRun:
    """The rules of one profile bound to one batch.

    ``order`` names columns that define the row order; without it rows keep the
    position their source gave them.
    """

    batch: DataFrame
    profile: Profile
    references: dict[str, DataFrame | Reference] = field(default_factory=dict)
    table: str = ""
    today: str | None = None
    order: list[str] | None = None

    def __post_init__(self) -> None:
        self.table = self.table or self.profile.name
        self.refs = as_references(self.references)

    @property
    def today_column(self) -> Column:
        return F.lit(self.today).cast("timestamp") if self.today else F.current_date().cast("timestamp")

    @cached_property
    def rows(self) -> DataFrame:
        return with_identity(self.batch, list(self.profile.primary_key), self.order)

    @cached_property
    def total_rows(self) -> int:
        return self.batch.count()

    @cached_property
    def outlier_fits(self) -> list[OutlierFit]:
        return fit_outliers(self.batch, self.profile)

    @cached_property
    def row_rules(self) -> list[RowRule]:
        df = self.batch
        return [
            *completeness_rules(df, self.profile),
            *validity_rules(df, self.profile, self.today_column),
            *expression_rules(df, self.profile),
            *outlier_rules(df, self.outlier_fits),
        ]

    @cached_property
    def entries(self) -> list[Entry]:
        """What rows put into groups; the first entry is the one that whole-row duplicates share."""
        df = self.batch
        return [*uniqueness_entries(df, self.profile), *reference_entries(df, self.profile, self.refs)]

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdicts(self.batch, self.entries)

    @cached_property
    def equal_rows(self) -> DataFrame:
        rows = self.rows if POSITION in self.batch.columns else self.batch  # counts alone need no positions
        return equal_rows(rows, self.entries[0], self.verdicts, self.total_rows)

    @cached_property
    def rules(self) -> list[Rule]:
        return [*self.row_rules, row_rule(), *[m.rule for e in self.entries for m in e.members]]

    @cached_property
    def counts(self) -> DataFrame:
        """Rows checked and failed per rule: one scan for row rules, one for keys, one for lookups, whatever their number."""
        parts = [tally(self.batch, self.row_rules)] if self.row_rules else []
        parts.append(row_duplicate_counts(self.equal_rows, self.total_rows))
        grouped = group_counts(self.verdicts, self.entries, self.total_rows)
        return reduce(DataFrame.unionByName, parts + ([grouped] if grouped is not None else []))

    @cached_property
    def results(self) -> DataFrame:
        """One row per rule, evaluated once; there are as many as the profile has rules."""
        rows = rule_results(self.counts, self.rules).collect()
        return small_table(self.batch.sparkSession, [tuple(r) for r in rows], RESULT_SCHEMA)

    @cached_property
    def positioned_findings(self) -> DataFrame:
        """Two passes over the rows, one of them only where rows are equal; a profile's size does not change that."""
        rows = self.rows
        equal = self.equal_rows if POSITION in self.batch.columns else equal_rows(rows, self.entries[0], self.verdicts, self.total_rows)
        found = findings(rows, self.row_rules, self.entries, self.verdicts, self.table, self.total_rows)
        return found.unionByName(row_duplicate_findings(rows, equal, self.table, self.total_rows))

    def findings(self) -> DataFrame:
        """One row per failing row and rule; never collected, only joined or written."""
        return self.positioned_findings.select(*FINDING_COLUMNS)

    @property
    def n_columns(self) -> int:
        return len(data_columns(self.batch))
