"""Uniqueness rules: Q-ROWDUP, Q-PK and Q-UNIQUE.

Everything starts from counts per key, which combine before the shuffle, so a
key that holds a third of the table costs one counter per task. Whole rows are
compared only among rows that already share a key (the primary key where there
is one, else a 128-bit row hash), so the wide comparison sees few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from assayer.functions.coerce import column
from assayer.operators.groups import ABSENT, COLLIDE, COPIES, Entry, Member, exact_key, failing_groups, present_key
from assayer.operators.identity import POSITION, ROW_KEY, data_columns
from assayer.operators.rules import Rule, rule_counts
from assayer.operators.skew import rows_of_groups
from assayer.plans.profile import Profile
from assayer.session import settled

# Rule ids of the register.
ROW_RULE = "expect_table_rows_to_be_unique"
KEY_RULE = "expect_primary_key_to_be_unique"
UNIQUE_RULE = "expect_column_values_to_be_unique"


def key_columns(df: DataFrame, profile: Profile) -> list[str]:
    return [k for k in profile.primary_key if k in df.columns]


def row_rule() -> Rule:
    return Rule(ROW_RULE, "uniqueness", None, "Rows must not be exact duplicates of one another", 0.7)


def uniqueness_entries(df: DataFrame, profile: Profile) -> list[Entry]:
    """The key (or row hash) that whole-row duplicates share comes first; a unique column that is the key reads its groups."""
    keys = key_columns(df, profile)
    unique = {c.name: Member(Rule(f"{UNIQUE_RULE}.{c.name}", "uniqueness", c.name, f"'{c.name}' must be unique", 0.8, c.weight))
              for c in profile.columns if c.unique and c.name in df.columns}
    if not keys:
        columns = data_columns(df)
        hashes = F.concat_ws(":", *[h.cast("string") for h in (F.xxhash64(*[column(c) for c in columns]),
                                                               F.xxhash64(F.lit(17), *[column(c) for c in reversed(columns)]))])
        entries = [Entry(COLLIDE, hashes)]
    else:
        members = [Member(Rule(KEY_RULE, "uniqueness", ",".join(keys), f"Primary key {keys} must identify at most one row", 1.0, 2.0,
                               detail={"primary_key": keys}))]
        if len(keys) == 1 and keys[0] in unique:
            floating = isinstance(df.schema[keys[0]].dataType, (T.FloatType, T.DoubleType))
            members.append(Member(unique.pop(keys[0]).rule, ~F.col("key").isin(ABSENT, *(["=NaN"] if floating else []))))
        entries = [Entry(COLLIDE, exact_key(df, keys), tuple(members))]
    return entries + [Entry(COLLIDE, present_key(df, name), (member,)) for name, member in unique.items()]


def equal_rows(df: DataFrame, entry: Entry, found: DataFrame, total_rows: int) -> DataFrame:
    """Groups of fully equal rows with their number and, where rows have one, their smallest position; written once.

    ``entry`` is the first of :func:`uniqueness_entries`, ``found`` its verdicts.
    """
    suspects = rows_of_groups(df.withColumn("__key", entry.key), failing_groups(found, 0).select(F.col("key").alias("__key"), COPIES),
                              ["__key"], COPIES, total_rows).drop("__key", COPIES)
    first = [F.min(POSITION).alias("__first")] if POSITION in df.columns else []
    grouped = suspects.groupBy(*[column(c) for c in data_columns(df)]).agg(F.count(F.lit(1)).alias("__copies"), *first)
    return settled(grouped.filter(F.col("__copies") > 1))


def row_duplicate_counts(equal: DataFrame, total_rows: int) -> DataFrame:
    later = equal.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("f"))
    return rule_counts(later, [(ROW_RULE, str(total_rows), "f")])


def row_duplicate_findings(df: DataFrame, equal: DataFrame, table: str, total_rows: int) -> DataFrame:
    """Later copies of equal rows."""
    later = rows_of_groups(df, equal, data_columns(df), "__copies", total_rows).filter(F.col(POSITION) > F.col("__first"))
    return later.select(F.lit(table).alias("table"), F.col(ROW_KEY).alias("row_key"), F.lit(None).cast("string").alias("column"),
                        F.lit(ROW_RULE).alias("rule_id"), F.lit("uniqueness").alias("dimension"), F.col(POSITION))
