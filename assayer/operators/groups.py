"""Rules decided by a group of rows: keys held twice, keys unknown elsewhere, values that differ from another table's.

Each row has at most one (entry, key, value) per entry, and all entries of a batch are exploded together, so the number of rules does not change the number
of scans: one pass counts the keys of all uniqueness and foreign key rules, one the (key, value) pairs of all lookups. Keys are exact texts. Failing groups
are written once, together with one row of totals per entry, and serve both the counts and the findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions.coerce import column, missing
from assayer.operators.identity import POSITION, ROW_KEY
from assayer.operators.rules import Rule, RowRule, listed, rule_counts
from assayer.operators.skew import rows_of_groups
from assayer.session import settled

COLLIDE, KNOWN, MATCH = "collide", "known", "match"
COPIES = "copies"
#: How a missing part of a key is written; present ones start with another sign.
ABSENT = "-"


@dataclass(frozen=True)
class Member:
    """A rule that reads an entry's groups; ``only`` is a condition on their keys."""

    rule: Rule
    only: Column | None = None


@dataclass(frozen=True)
class Entry:
    """What a row puts into groups.

    COLLIDE: a key fails when more than one row holds it. KNOWN: when it is not
    among the keys of ``facts``. MATCH: when the row's value is another one than
    ``expected`` in ``facts``; keys without a fact are not checked. Rows with a
    null key, or with a null value in a MATCH, are left out.
    """

    kind: str
    key: Column
    members: tuple[Member, ...] = ()
    value: Column | None = None
    facts: DataFrame | None = None


def _part(name: str, kind: T.DataType) -> Column:
    value = column(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value)  # both zeros are one
    if isinstance(kind, T.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)  # local texts repeat when clocks are set back
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        value = F.when(value.isNotNull(), F.to_json(F.struct(value)))
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(ABSENT))


def exact_key(df: DataFrame, names: Sequence[str]) -> Column:
    """Columns as one text that differs when any of them does."""
    parts = [_part(n, df.schema[n].dataType) for n in names]
    return parts[0] if len(parts) == 1 else F.concat(*[F.concat(F.length(p).cast("string"), p) for p in parts])


def present_key(df: DataFrame, name: str) -> Column:
    """One column as :func:`exact_key`, null where the value is missing."""
    return F.when(~missing(column(name), df.schema[name].dataType), exact_key(df, [name]))


def _cell(i: int, entry: Entry) -> Column:
    value = F.lit(None) if entry.value is None else entry.value
    return F.struct(F.lit(i).alias("entry"), entry.key.alias("key"), value.cast("string").alias("value"))


def _cells(df: DataFrame, entries: dict[int, Entry]) -> DataFrame:
    return df.select(F.explode(F.array(*[_cell(i, e) for i, e in entries.items()])).alias("c")).select("c.*").filter(F.col("key").isNotNull())


def _facts(entries: dict[int, Entry]) -> DataFrame | None:
    parts = [e.facts.select(F.lit(i).alias("entry"), "key", F.col("expected").cast("string").alias("expected"))
             for i, e in entries.items() if e.facts is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _judged_keys(df: DataFrame, entries: dict[int, Entry]) -> DataFrame:
    """Facts join the same grouping as rows without a copy, so known keys need no join."""
    rows = _cells(df, entries).select("entry", "key", F.lit(1).alias("n"))
    known = _facts(entries)
    if known is not None:
        rows = rows.unionByName(known.select("entry", "key", F.lit(None).cast("int").alias("n")))
    counted = rows.groupBy("entry", "key").agg(F.count("n").alias(COPIES), F.bool_or(F.col("n").isNull()).alias("known"))
    collide = [i for i, e in entries.items() if e.kind == COLLIDE]
    failed = F.when(F.col("entry").isin(*collide), F.col(COPIES) > 1).otherwise(~F.col("known")) if collide else ~F.col("known")
    return counted.filter(F.col(COPIES) > 0).select(
        "entry", "key", F.lit(None).cast("string").alias("value"), COPIES, F.lit(True).alias("checked"), failed.alias("failed"))


def _judged_pairs(df: DataFrame, entries: dict[int, Entry]) -> DataFrame:
    counted = _cells(df, entries).filter(F.col("value").isNotNull()).groupBy("entry", "key", "value").agg(F.count(F.lit(1)).alias(COPIES))
    return counted.join(_facts(entries), ["entry", "key"], "left").select(
        "entry", "key", "value", COPIES, F.col("expected").isNotNull().alias("checked"),
        F.coalesce(F.col("expected") != F.col("value"), F.lit(False)).alias("failed"))


def verdicts(df: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """(entry, key, value, copies, checked, failed): failing groups one by one, sound ones added up per entry. Written once."""
    keys = {i: e for i, e in enumerate(entries) if e.kind != MATCH}
    pairs = {i: e for i, e in enumerate(entries) if e.kind == MATCH}
    parts = ([_judged_keys(df, keys)] if keys else []) + ([_judged_pairs(df, pairs)] if pairs else [])
    judged = reduce(DataFrame.unionByName, parts)

    def failing(c: str) -> Column:
        return F.when(F.col("failed"), F.col(c))

    pooled = judged.groupBy("entry", "failed", failing("key").alias("key"), failing("value").alias("value")).agg(
        F.sum(COPIES).alias(COPIES), F.coalesce(F.sum(F.when(F.col("checked"), F.col(COPIES))), F.lit(0)).alias("checked"))
    return settled(pooled.select("entry", "key", "value", COPIES, "checked", "failed"))


def failing_groups(found: DataFrame, entry: int | None = None) -> DataFrame:
    kept = found.filter("failed")
    return (kept if entry is None else kept.filter(F.col("entry") == entry)).select("entry", "key", "value", COPIES)


def group_counts(found: DataFrame, entries: Sequence[Entry], total_rows: int) -> DataFrame | None:
    """Rows checked and failed per rule; a uniqueness rule checks every row."""
    sums, rules = [], []
    for i, entry in enumerate(entries):
        here = F.col("entry") == i
        for j, member in enumerate(entry.members):
            hit = here & F.col("failed") & (F.lit(True) if member.only is None else member.only)
            sums += [F.coalesce(F.sum(F.when(hit, F.col(COPIES))), F.lit(0)).alias(f"f{i}_{j}"),
                     F.coalesce(F.sum(F.when(here, F.col("checked"))), F.lit(0)).alias(f"c{i}_{j}")]
            rules.append((member.rule.rule_id, str(total_rows) if entry.kind == COLLIDE else f"c{i}_{j}", f"f{i}_{j}"))
    return rule_counts(found.agg(*sums), rules) if rules else None


def findings(rows: DataFrame, row_rules: Sequence[RowRule], entries: Sequence[Entry], found: DataFrame, table: str, total_rows: int) -> DataFrame:
    """One row per failing row and rule of all row rules and all entries, from one pass over ``rows``.

    Entries without a failing group are left out of the pass.
    """
    failing = failing_groups(found)
    hit = {r["entry"] for r in failing.select("entry").distinct().collect()}  # at most one row per entry
    used = {i: e for i, e in enumerate(entries) if i in hit and e.members}
    name = "column string, rule_id string, dimension string"

    def about(rule: Rule) -> Column:
        return F.struct(F.lit(rule.column).cast("string").alias("column"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.dimension).alias("dimension"))

    cell = "entry int, key string, value string"
    marks = [F.when(r.failing(), F.struct(about(r).alias("own"), F.lit(None).cast(f"struct<{_typed(cell)}>").alias("cell"))) for r in row_rules]
    marks += [F.when(e.key.isNotNull(), F.struct(F.lit(None).cast(f"struct<{_typed(name)}>").alias("own"), _cell(i, e).alias("cell")))
              for i, e in used.items()]
    if not marks:
        marks = [F.lit(None).cast(f"struct<own: struct<{_typed(name)}>, cell: struct<{_typed(cell)}>>")]
    exploded = listed(rows.select(F.lit(table).alias("table"), F.col(ROW_KEY).alias("row_key"), F.col(POSITION), F.array(*marks).alias("__marks")), "m")
    told = F.col("m.own")
    if used:
        exploded = rows_of_groups(
            exploded.select("table", "row_key", POSITION, F.col("m.own").alias("own"), "m.cell.*"),
            failing.filter(F.col("entry").isin(*used)), ["entry", "key", "value"], COPIES, total_rows * len(used), sure=F.col("own").isNotNull())
        members = [F.when((F.col("entry") == i) & (F.lit(True) if m.only is None else m.only), about(m.rule)) for i, e in used.items() for m in e.members]
        exploded = listed(exploded.select("table", "row_key", POSITION, F.array(F.col("own"), *members).alias("__marks")), "one")
        told = F.col("one")
    return exploded.select("table", "row_key", *[told[c].alias(c) for c in ("column", "rule_id", "dimension")], POSITION)


def _typed(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in fields.split(", ")))
