"""Rules against other tables: Q-FK, Q-LOOKUP and Q-HEADERSUM.

The batch is counted per key before it meets the reference table, so a frequent
key is one row in any join. The counting itself is that of ``groups``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import as_number, as_text, column, missing
from assayer.operators.groups import KNOWN, MATCH, Entry, Member
from assayer.operators.rules import Rule
from assayer.plans.profile import CrossRule, Profile


@dataclass(frozen=True)
class Reference:
    """A reference table; ``order`` names the columns that say which row of a key comes first."""

    table: DataFrame
    order: tuple[str, ...] = ()


def as_references(tables: dict[str, DataFrame | Reference] | None) -> dict[str, Reference]:
    return {n: t if isinstance(t, Reference) else Reference(t) for n, t in (tables or {}).items()}


def applicable(df: DataFrame, profile: Profile, refs: dict[str, Reference]) -> list[CrossRule]:
    """Cross-table rules whose tables and columns are all there."""
    found = []
    for rule in profile.rules:
        if rule.kind == "expression" or rule.ref_table not in refs:
            continue
        local = {c for c in (rule.column, rule.local_key) if c}
        remote = {c for c in (rule.ref_column, rule.ref_key) if c}
        if local <= set(df.columns) and remote <= set(refs[rule.ref_table].table.columns):
            found.append(rule)
    return found


def _present(df: DataFrame, name: str) -> Column:
    """The column as text, null where it is missing."""
    return F.when(~missing(column(name), df.schema[name].dataType), as_text(column(name)))


def _cents(value: Column) -> Column:
    """An amount of money as text; both zeros are one."""
    rounded = F.round(value, 2)
    return F.when(rounded == 0, "0").otherwise(rounded.cast("string"))


def _first_values(ref: Reference, key: str, value: str) -> DataFrame:
    """One value per key: that of its first row, or the smallest one when no order is known."""
    text = _present(ref.table, value)
    chosen = F.min_by(text, F.struct(*[column(o) for o in ref.order])) if ref.order else F.min(text)
    return ref.table.groupBy(_present(ref.table, key).alias("key")).agg(chosen.alias("expected")).filter("key IS NOT NULL")


def _sums(ref: Reference, key: str, value: str) -> DataFrame:
    amount = as_number(column(value), ref.table.schema[value].dataType)
    grouped = ref.table.groupBy(_present(ref.table, key).alias("key")).agg(F.sum(amount).alias("sum"))
    return grouped.filter("key IS NOT NULL").select("key", _cents(F.col("sum")).alias("expected"))


def _rule(rule: CrossRule) -> Rule:
    return Rule(f"consistency.{rule.id}", "consistency", rule.column, rule.description, rule.impact,
                detail={"ref_table": rule.ref_table, "ref_column": rule.ref_column})


def reference_entries(df: DataFrame, profile: Profile, refs: dict[str, Reference]) -> list[Entry]:
    """What the rows put into groups for the rules against other tables, with what the reference tables say of the keys."""
    entries = []
    for rule in applicable(df, profile, refs):
        ref, members = refs[rule.ref_table], (Member(_rule(rule)),)
        if rule.kind == "foreign_key":
            known = ref.table.select(_present(ref.table, rule.ref_column).alias("key"), F.lit(None).cast("string").alias("expected"))
            entries.append(Entry(KNOWN, _present(df, rule.column), members, facts=known.filter("key IS NOT NULL")))
        elif rule.kind == "lookup_match":
            entries.append(Entry(MATCH, _present(df, rule.local_key), members, _present(df, rule.column),
                                 _first_values(ref, rule.ref_key, rule.ref_column)))
        else:
            total = as_number(column(rule.column), df.schema[rule.column].dataType)
            entries.append(Entry(MATCH, _present(df, rule.local_key), members, _cents(total), _sums(ref, rule.ref_key, rule.ref_column)))
    return entries


def ambiguous_references(df: DataFrame, profile: Profile, refs: dict[str, Reference]) -> list[str]:
    """Lookup rules whose reference holds keys with several values and no stated order."""
    notes = []
    for rule in applicable(df, profile, refs):
        ref = refs[rule.ref_table]
        if rule.kind != "lookup_match" or ref.order:
            continue
        keyed = ref.table.groupBy(column(rule.ref_key)).agg(
            F.min(column(rule.ref_column)).alias("a"), F.max(column(rule.ref_column)).alias("b"))
        if not keyed.filter("a <> b").isEmpty():
            notes.append(f"Rule {rule.id}: {rule.ref_table} holds several values for one key; the smallest was used.")
    return notes
