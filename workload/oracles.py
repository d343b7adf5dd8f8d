"""The registered queries once more, as SQL for DuckDB, written from the rules' definitions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from assayer.plans.severity import FAMILY_ACTIONS, RULE_ACTIONS, TRUNCATED_ACTION
from workload import bindings as B

ORACLES: dict[str, str] = {}
NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


def uniform(*parts: str) -> str:
    return f"({draw(*parts)} / 4503599627370496.0)"


def number(text: str) -> str:
    return f"(CASE WHEN regexp_matches({text}, {NUMBER}) THEN TRY_CAST({text} AS DOUBLE) END)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- the batches ------------------------------------------------------------------------

CLEAN_HEADERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       o_orderdate + to_days(CAST(o_orderkey % 30 + 1 AS INTEGER)) AS o_duedate,
       o_totalprice * 0.5 AS o_netprice, c_mktsegment AS o_segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def _hit(label: str, rate: float) -> str:
    return f"{uniform('o_orderkey', quoted(label))} < {rate}"


_DIRTY_ONCE = f"""
SELECT o_orderkey,
       CASE WHEN {_hit('fk', 0.004)} THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey,
       CASE WHEN {_hit('cat', 0.02)} THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN {_hit('null', 0.012)} THEN NULL
            WHEN {_hit('type', 0.005)} THEN translate(format('{{:,.2f}}', o_totalprice), ',.', '.,')
            WHEN {_hit('neg', 0.004)} THEN CAST(-o_totalprice AS VARCHAR)
            ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
       CASE WHEN {_hit('future', 0.002)} THEN o_orderdate + to_days(4000) ELSE o_orderdate END AS o_orderdate,
       CASE WHEN {_hit('enc', 0.01)} THEN o_orderpriority || '   ' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN {_hit('late', 0.007)} THEN o_orderdate - to_days(5) ELSE o_duedate END AS o_duedate,
       CASE WHEN {_hit('net', 0.009)} THEN o_netprice * 1.25 ELSE o_netprice END AS o_netprice,
       CASE WHEN {_hit('seg', 0.008)} THEN 'UNKNOWN' ELSE o_segment END AS o_segment
FROM ({CLEAN_HEADERS})"""
DIRTY_HEADERS = f"{_DIRTY_ONCE} UNION ALL SELECT * FROM ({_DIRTY_ONCE}) WHERE {_hit('dup', 0.005)}"


# --- rules as SQL conditions ------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: str
    column: str | None
    failed: str
    impact: float
    weight: float
    description: str
    checked: str = "TRUE"
    tolerance: float | None = None
    zero: bool = False


def present(c: str) -> str:
    return f"{c} IS NOT NULL"


def null_rule(c: str, weight: float = 1.0, tolerance: float = 0.0, impact: float = 0.9) -> Rule:
    return Rule(f"expect_column_values_to_not_be_null.{c}", "completeness", c, f"{c} IS NULL", impact, weight, "",
                tolerance=tolerance)


def type_rule(c: str, dtype: str, parsed: str, weight: float = 1.0) -> Rule:
    return Rule(f"expect_column_values_to_be_of_type.{c}", "validity", c, f"{parsed} IS NULL", 0.7, weight,
                f"'{c}' must parse as {dtype}", present(c))


def range_rule(c: str, parsed: str, low: float | None, high: float | None, weight: float = 1.0) -> Rule:
    tests = ([f"{parsed} < {low}"] if low is not None else []) + ([f"{parsed} > {high}"] if high is not None else [])
    return Rule(f"expect_column_values_to_be_between.{c}", "validity", c, "(" + " OR ".join(tests) + ")", 0.75,
                weight, f"'{c}' must fall within [{low}, {high}]", f"{parsed} IS NOT NULL")


def date_rule(c: str, low: str | None, high: str | None, weight: float = 1.0) -> Rule:
    tests = ([f"{c} < TIMESTAMP '{low}'"] if low else []) + (
        [f"{c} > TIMESTAMP '{B.TODAY if high == 'today' else high}'"] if high else [])
    return Rule(f"expect_column_dates_to_be_between.{c}", "validity", c, "(" + " OR ".join(tests) + ")", 0.7, weight,
                f"'{c}' must fall within [{low}, {high}]", present(c))


def set_rule(c: str, words: tuple[str, ...], weight: float = 1.0) -> Rule:
    listed = ", ".join(quoted(w) for w in words)
    return Rule(f"expect_column_values_to_be_in_set.{c}", "validity", c, f"CAST({c} AS VARCHAR) NOT IN ({listed})",
                0.55, weight, f"'{c}' must be one of {sorted(words)}", present(c))


def regex_rule(c: str, pattern: str, weight: float = 1.0) -> Rule:
    return Rule(f"expect_column_values_to_match_regex.{c}", "validity", c,
                f"NOT regexp_full_match({c}, {quoted(pattern)})", 0.6, weight, f"'{c}' must match /{pattern}/",
                present(c))


def key_rules(key: str, all_columns: list[str], weight: float) -> list[Rule]:
    listed = ", ".join(all_columns)
    return [
        Rule("expect_table_rows_to_be_unique", "uniqueness", None,
             f"row_number() OVER (PARTITION BY {listed}) > 1", 0.7, 1.0,
             "Rows must not be exact duplicates of one another"),
        Rule("expect_primary_key_to_be_unique", "uniqueness", key, f"count(*) OVER (PARTITION BY {key}) > 1", 1.0, 2.0,
             f"Primary key ['{key}'] must identify at most one row"),
        Rule(f"expect_column_values_to_be_unique.{key}", "uniqueness", key,
             f"({key} IS NOT NULL AND count(*) OVER (PARTITION BY {key}) > 1)", 0.8, weight, f"'{key}' must be unique"),
    ]


def outlier_rule(c: str, parsed: str, cut: float, src: str) -> Rule:
    """Raw scale only: the registered batches are not strongly skewed."""
    fit = (f"(SELECT median(v) FROM (SELECT {parsed} AS v FROM {src}))")
    mad = f"(SELECT median(abs(v - m)) FROM (SELECT {parsed} AS v, {fit} AS m FROM {src}))"
    return Rule(f"expect_column_values_to_be_plausible.{c}", "plausibility", c,
                f"abs({parsed} - {fit}) / (1.4826 * {mad}) > {cut}", 0.35, 1.0,
                f"'{c}' values beyond {cut} robust standard deviations of the median", f"{parsed} IS NOT NULL")


HEADER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                  "o_duedate", "o_netprice", "o_segment"]
PRICE = number("o_totalprice")


def header_rules(src: str, customers: str, custkey: str) -> list[Rule]:
    ref = f"(SELECT CAST(c_custkey AS VARCHAR) AS k, min(c_mktsegment) AS s FROM {customers} GROUP BY 1)"
    expected = f"(SELECT s FROM {ref} r WHERE r.k = CAST(o_custkey AS VARCHAR))"
    completeness = [
        null_rule("o_orderkey", 2.0), null_rule("o_custkey"), null_rule("o_orderstatus"),
        null_rule("o_totalprice", 2.0, 0.01), null_rule("o_orderdate", 1.5), null_rule("o_orderpriority"),
        null_rule("o_duedate"), null_rule("o_netprice"), null_rule("o_segment"),
        Rule("expect_column_to_exist.o_clerk", "completeness", "o_clerk", "TRUE", 0.9, 0.5,
             "Column 'o_clerk' is missing from the batch", zero=True)]
    validity = [
        type_rule("o_orderkey", "int", "o_orderkey", 2.0), type_rule("o_custkey", "int", custkey),
        set_rule("o_orderstatus", ("F", "O", "P")), type_rule("o_totalprice", "float", PRICE, 2.0),
        range_rule("o_totalprice", PRICE, 0.01, None, 2.0), type_rule("o_orderdate", "datetime", "o_orderdate", 1.5),
        date_rule("o_orderdate", "1990-01-01", "today", 1.5), regex_rule("o_orderpriority", "[1-5]-[A-Z ]*[A-Z]"),
        type_rule("o_duedate", "datetime", "o_duedate"), date_rule("o_duedate", "1990-01-01", None),
        type_rule("o_netprice", "float", "o_netprice"), range_rule("o_netprice", "o_netprice", 0.0, None),
        set_rule("o_segment", B.SEGMENTS)]
    consistency = [
        Rule("consistency.due_after_order", "consistency", None, "o_duedate < o_orderdate", 0.8, 1.0,
             "Due date must not precede the order date", "(o_duedate IS NOT NULL AND o_orderdate IS NOT NULL)"),
        Rule("consistency.net_is_half_of_total", "consistency", None,
             f"NOT (abs(o_netprice - {PRICE} * 0.5) <= 0.01)", 0.85, 1.0, "Net price must be half of the total price",
             f"(o_netprice IS NOT NULL AND {PRICE} IS NOT NULL)"),
        Rule("consistency.customer_exists", "consistency", "o_custkey",
             f"CAST(o_custkey AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM {customers})", 0.95, 1.0,
             "Every order must reference an existing customer", present("o_custkey")),
        Rule("consistency.segment_matches_customer", "consistency", "o_segment", f"o_segment <> {expected}", 0.7, 1.0,
             "Order segment must match the customer master", f"(o_segment IS NOT NULL AND {expected} IS NOT NULL)")]
    return [*completeness, *validity, *key_rules("o_orderkey", HEADER_COLUMNS, 2.0), *consistency,
            outlier_rule("o_totalprice", PRICE, 4.0, src), outlier_rule("o_netprice", "o_netprice", 4.0, src)]


def part_rules(src: str) -> list[Rule]:
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return [
        *[null_rule(c, w) for c, w in zip(columns, (2.0, 1.5, 1.0, 1.0, 1.0, 1.5))],
        type_rule("p_partkey", "int", "p_partkey", 2.0), regex_rule("p_name", "[a-z][a-z ]*[a-z]", 1.5),
        regex_rule("p_brand", "Brand#[0-9]+"), set_rule("p_type", B.PART_TYPES), type_rule("p_size", "int", "p_size"),
        range_rule("p_size", "p_size", 1.0, 50.0), type_rule("p_retailprice", "float", "p_retailprice", 1.5),
        range_rule("p_retailprice", "p_retailprice", 0.01, None, 1.5), *key_rules("p_partkey", columns, 2.0),
        outlier_rule("p_retailprice", "p_retailprice", 4.0, src)]


def customer_rules() -> list[Rule]:
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return [
        null_rule("c_custkey", 2.0), null_rule("c_name", 1.5), null_rule("c_acctbal"), null_rule("c_mktsegment", 1.5),
        type_rule("c_custkey", "int", "c_custkey", 2.0), regex_rule("c_name", "Customer#[0-9]{9}", 1.5),
        type_rule("c_acctbal", "float", "c_acctbal"), set_rule("c_mktsegment", B.SEGMENTS, 1.5),
        *key_rules("c_custkey", columns, 2.0)]


def _judged(src: str, rules: list[Rule]) -> str:
    columns = ", ".join(f"({r.checked}) AS c{i}, ({r.checked}) AND ({r.failed}) AS f{i}" for i, r in enumerate(rules))
    return f"SELECT *, {columns} FROM {src}"


def tally(src: str, rules: list[Rule]) -> str:
    """One row per rule; rules other than completeness and consistency are left out when nothing was checked."""
    counts = ", ".join(f"count(*) FILTER (WHERE c{i}) AS c{i}, count(*) FILTER (WHERE f{i}) AS f{i}"
                       for i in range(len(rules)))
    rows = []
    for i, r in enumerate(rules):
        score = f"CASE WHEN c{i} > 0 THEN 1 - f{i} / c{i} ELSE 1.0 END"
        text = quoted(r.description)
        if r.zero:
            score = "0.0"
        if r.tolerance is not None:
            score = f"1 - greatest(0.0, f{i} / c{i} - {r.tolerance}) / {1.0 - r.tolerance}"
            text = (f"'''{r.column}'' is ' || format('{{:.2f}}', 100.0 * f{i} / c{i}) || '% null (tolerance "
                    f"{r.tolerance:.2%})'")
        column = quoted(r.column) if r.column else "NULL"
        rows.append(f"SELECT {quoted(r.id)} AS rule_id, '{r.dimension}' AS dimension, {column} AS \"column\", "
                    f"{text} AS description, CAST(c{i} AS BIGINT) AS n_checked, CAST(f{i} AS BIGINT) AS n_failed, "
                    f"CAST({score} AS DOUBLE) AS score, CAST({r.impact} AS DOUBLE) AS impact, "
                    f"CAST({r.weight} AS DOUBLE) AS weight FROM counted")
    return (f"WITH judged AS MATERIALIZED ({_judged(src, rules)}), counted AS (SELECT {counts} FROM judged) "
            + " UNION ALL ".join(rows))


def findings(table: str, src: str, rules: list[Rule], key: str) -> str:
    parts = [
        f"SELECT '{table}' AS \"table\", CAST({key} AS VARCHAR) AS row_key, "
        f"{quoted(r.column) if r.column else 'NULL'} AS \"column\", {quoted(r.id)} AS rule_id, "
        f"'{r.dimension}' AS dimension FROM judged WHERE f{i}" for i, r in enumerate(rules)]
    return f"WITH judged AS MATERIALIZED ({_judged(src, rules)}) " + " UNION ALL ".join(parts)


RESULT_COLUMNS = ("rule_id, dimension, \"column\", description, n_checked, n_failed, round(score, 6) AS score, "
                  "impact, weight")
HEADERS = f"({DIRTY_HEADERS}) h"
HEADER_RULES = header_rules("dirty", "customer", "o_custkey")


def with_dirty(body: str) -> str:
    return f"WITH dirty AS MATERIALIZED ({DIRTY_HEADERS}) {body}"


def header_results(prefix: str = "", kind: str = "") -> str:
    chosen = [r for r in HEADER_RULES if r.id.startswith(prefix) and (not kind or r.dimension == kind)]
    return with_dirty(f"SELECT {RESULT_COLUMNS} FROM ({tally('dirty', chosen)})")


ORACLES["completeness_scores"] = header_results(kind="completeness")
ORACLES["type_parse_failures"] = header_results("expect_column_values_to_be_of_type.")
ORACLES["range_violations"] = header_results("expect_column_values_to_be_between.")
ORACLES["date_range_violations"] = header_results("expect_column_dates_to_be_between.")
ORACLES["vocabulary_violations"] = header_results("expect_column_values_to_be_in_set.")
ORACLES["regex_violations"] = header_results("expect_column_values_to_match_regex.")
ORACLES["row_duplicates"] = header_results("expect_table_rows_to_be_unique")
ORACLES["primary_key_collisions"] = header_results("expect_primary_key_to_be_unique")
ORACLES["column_uniqueness"] = header_results("expect_column_values_to_be_unique.")
ORACLES["expression_consistency"] = with_dirty(
    f"SELECT {RESULT_COLUMNS} FROM "
    f"({tally('dirty', [r for r in HEADER_RULES if r.dimension == 'consistency' and r.column is None])})")
ORACLES["foreign_key_orphans"] = header_results("consistency.customer_exists")
ORACLES["lookup_mismatches"] = header_results("consistency.segment_matches_customer")
ORACLES["rule_results"] = header_results()

LINE_KEY = Rule("expect_primary_key_to_be_unique", "uniqueness", "l_orderkey,l_linenumber",
                "count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1", 1.0, 2.0,
                "Primary key ['l_orderkey', 'l_linenumber'] must identify at most one row")
ORACLES["lineitem_key_collisions"] = f"SELECT {RESULT_COLUMNS} FROM ({tally('lineitem', [LINE_KEY])})"
ORACLES["header_totals"] = f"""
WITH lines AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
heads AS (SELECT l_orderkey AS order_id,
                 round(s, 2) + CASE WHEN {uniform('l_orderkey', quoted('sum'))} < 0.01 THEN 1 ELSE 0 END AS total
          FROM lines),
pairs AS (SELECT order_id, total, s FROM heads JOIN lines ON order_id = l_orderkey)
SELECT {RESULT_COLUMNS} FROM ({tally('pairs', [Rule(
    'consistency.total_is_sum_of_lines', 'consistency', 'total', 'round(total, 2) <> round(s, 2)', 0.8, 1.0,
    'Total must equal the sum of its lines')])})"""
ORACLES["ship_before_order"] = f"""
WITH shipped AS (SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT {RESULT_COLUMNS} FROM ({tally('shipped', [Rule(
    'consistency.shipped_after_order', 'consistency', None, 'l_shipdate < o_orderdate', 0.8, 1.0,
    'Lines ship after their order')])})"""


def outliers(name: str, value: str, source: str, cut: float) -> str:
    return f"""
WITH raw AS (SELECT {value} AS x FROM {source}),
shape AS (SELECT (min(x) >= 0 AND skewness(x) > 2.0) AS logged FROM raw),
scaled AS (SELECT CASE WHEN logged THEN ln(1 + x) ELSE x END AS v, logged FROM raw, shape),
mid AS (SELECT median(v) AS m FROM scaled),
fit AS (SELECT any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM scaled, mid)
SELECT 'expect_column_values_to_be_plausible.{name}' AS rule_id, count(*) AS n_checked,
       count(*) FILTER (WHERE abs(v - m) / s > {cut}) AS n_failed,
       round(1 - count(*) FILTER (WHERE abs(v - m) / s > {cut}) / count(*), 6) AS score,
       round(any_value(m), 6) AS median, round(any_value(s), 6) AS robust_scale,
       CAST(any_value(logged) AS VARCHAR) AS log_scaled
FROM scaled, fit"""


ORACLES["robust_outliers"] = outliers("value", "value", "events", 4.0)
ORACLES["robust_outliers_log"] = outliers("squared", "value * value", "events", 2.5)


# --- scores -----------------------------------------------------------------------------

DEFAULT_WEIGHTS = {"completeness": 0.25, "validity": 0.25, "consistency": 0.20, "uniqueness": 0.15,
                   "plausibility": 0.15}
CARD_WEIGHTS = {"completeness": 0.30, "validity": 0.30, "consistency": 0.10, "uniqueness": 0.15, "plausibility": 0.15}


def dimensions(results: str, weights: dict[str, float]) -> str:
    fixed = ", ".join(f"('{d}', CAST({w} AS DOUBLE))" for d, w in weights.items())
    return f"""
SELECT d.dimension, coalesce(s, 1.0) AS score, CASE WHEN n IS NULL THEN 0.0 ELSE w END AS weight,
       coalesce(n, 0) AS rules, coalesce(bad, 0) AS failed_rules
FROM (VALUES {fixed}) d(dimension, w) LEFT JOIN (
  SELECT dimension, sum(score * weight) / sum(weight) AS s, count(*) AS n, count(*) FILTER (WHERE n_failed > 0) AS bad
  FROM ({results}) GROUP BY 1) r ON r.dimension = d.dimension"""


def summary(table: str, source: str, results: str, columns: int, weights: dict[str, float] = DEFAULT_WEIGHTS,
            digits: int = 6, ctes: str = "") -> str:
    return f"""
WITH {ctes} results AS MATERIALIZED ({results}), dims AS ({dimensions('SELECT * FROM results', weights)}),
means AS (SELECT 100 * exp(sum(weight * ln(greatest(score, 0.01))) / sum(weight)) AS g,
                 100 * sum(weight * score) / sum(weight) AS a, min(score) FILTER (WHERE rules > 0) AS weakest FROM dims),
graded AS (SELECT *, CASE WHEN g >= 90 THEN 'A' WHEN g >= 80 THEN 'B' WHEN g >= 70 THEN 'C' WHEN g >= 60 THEN 'D'
                          ELSE 'F' END AS band,
           (SELECT count(*) FROM results WHERE rule_id = 'expect_primary_key_to_be_unique' AND n_failed > 0) AS broken
           FROM means)
SELECT '{table}' AS "table", (SELECT count(*) FROM {source}) AS n_rows, CAST({columns} AS INTEGER) AS n_columns,
       round(g, {digits}) AS global_score, round(a, {digits}) AS global_score_arithmetic,
       CASE WHEN broken > 0 THEN 'F' WHEN weakest < 0.5 AND band IN ('A', 'B', 'C') THEN 'D' ELSE band END AS grade,
       FALSE AS profile_inferred
FROM graded"""


DIRTY_CTE = f"dirty AS MATERIALIZED ({DIRTY_HEADERS}), "
ORACLES["dimension_scores"] = with_dirty(
    f"SELECT dimension, round(score * 100, 2) AS score, weight, rules, failed_rules FROM "
    f"({dimensions(tally('dirty', HEADER_RULES), DEFAULT_WEIGHTS)})")
ORACLES["batch_quality_score"] = summary("orders", "dirty", tally("dirty", HEADER_RULES), 9, ctes=DIRTY_CTE)

LINE_RULES = [
    *[null_rule(c.name, c.weight) for c in B.LINEITEM.columns],
    type_rule("l_orderkey", "int", "l_orderkey", 2.0), type_rule("l_partkey", "int", "l_partkey", 1.5),
    type_rule("l_suppkey", "int", "l_suppkey"), type_rule("l_linenumber", "int", "l_linenumber"),
    range_rule("l_linenumber", "l_linenumber", 1.0, 7.0), type_rule("l_quantity", "float", "l_quantity", 2.0),
    range_rule("l_quantity", "l_quantity", 1.0, 50.0, 2.0),
    type_rule("l_extendedprice", "float", "l_extendedprice", 2.0),
    range_rule("l_extendedprice", "l_extendedprice", 0.01, None, 2.0), type_rule("l_discount", "float", "l_discount"),
    range_rule("l_discount", "l_discount", 0.0, 0.1), type_rule("l_tax", "float", "l_tax"),
    range_rule("l_tax", "l_tax", 0.0, 0.08), set_rule("l_returnflag", ("A", "N", "R")),
    set_rule("l_linestatus", ("F", "O")), type_rule("l_shipdate", "datetime", "l_shipdate"),
    date_rule("l_shipdate", "1992-01-01", "2001-06-30"),
    Rule("expect_table_rows_to_be_unique", "uniqueness", None, "row_number() OVER (PARTITION BY "
         + ", ".join(c.name for c in B.LINEITEM.columns) + ") > 1", 0.7, 1.0, ""),
    LINE_KEY,
    Rule("consistency.order_exists", "consistency", "l_orderkey",
         "l_orderkey NOT IN (SELECT o_orderkey FROM orders)", 0.95, 1.0, "", present("l_orderkey")),
    Rule("consistency.part_exists", "consistency", "l_partkey",
         "l_partkey NOT IN (SELECT p_partkey FROM part)", 0.95, 1.0, "", present("l_partkey")),
]
ORACLES["lineitem_quality_score"] = summary("lineitem", "lineitem", tally("lineitem", LINE_RULES), 11)


# --- issue register ---------------------------------------------------------------------


def _action(rule_id: str) -> str:
    family = rule_id.split(".")[0]
    specific = RULE_ACTIONS.get(rule_id.partition(".")[2]) if family == "consistency" else None
    return specific or FAMILY_ACTIONS.get(family, FAMILY_ACTIONS["anomaly"])


_ACTIONS = ", ".join(f"({quoted(r.id)}, {quoted(_action(r.id))})" for r in HEADER_RULES)
_WEIGHTS = ", ".join(f"('{d}', {w})" for d, w in DEFAULT_WEIGHTS.items())
ISSUES = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY rule_id) AS no FROM ({tally('dirty', HEADER_RULES)})),
sized AS (SELECT n.*, a.action, greatest(n_checked, 1) AS seen, CASE WHEN n.dimension = 'plausibility' THEN 0.6 ELSE 1.0 END AS conf, w.w
          FROM numbered n JOIN (VALUES {_ACTIONS}) a(id, action) ON a.id = n.rule_id
          JOIN (VALUES {_WEIGHTS}) w(d, w) ON w.d = n.dimension WHERE n_failed > 0 AND score < 0.999),
raw AS (SELECT *, 100 * greatest(0.2, w / 0.25) * (0.45 * impact + 0.30 * sqrt(n_failed / seen) + 0.25 * conf) AS sev FROM sized),
issues AS (SELECT format('ISS-Q{{:04d}}', no) AS issue_id,
  CAST(row_number() OVER (ORDER BY sev DESC, n_failed DESC, rule_id) AS INTEGER) AS priority,
  CASE WHEN rule_id = 'expect_primary_key_to_be_unique' OR sev >= 75 THEN 'critical' WHEN sev >= 50 THEN 'high'
       WHEN sev >= 25 THEN 'medium' ELSE 'low' END AS severity,
  round(sev, 2) AS severity_score, 'quality_rule' AS source, dimension, rule_id,
  CASE WHEN "column" IS NULL THEN 'dataset' ELSE 'column' END AS scope, 'orders' AS "table", "column",
  n_failed AS n_records, round(n_failed / seen, 6) AS pct_affected,
  description || '. ' || format('{{:,}}', n_failed) || ' of ' || format('{{:,}}', n_checked) || ' rows checked failed ('
    || format('{{:.2f}}', 100.0 * n_failed / seen) || '%).' AS reason,
  action AS recommended_action FROM raw)"""
ISSUE_COLUMNS = ('issue_id, priority, severity, severity_score, source, dimension, rule_id, scope, "table", "column", '
                 "n_records, pct_affected, reason, recommended_action")
ORACLES["issue_register"] = f"WITH {DIRTY_CTE} {ISSUES} SELECT {ISSUE_COLUMNS} FROM issues"
ORACLES["severity_counts"] = f"""WITH {DIRTY_CTE} {ISSUES}
SELECT l.severity, count(i.severity) AS n_issues
FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) l(severity) LEFT JOIN issues i ON i.severity = l.severity
GROUP BY 1"""
ORACLES["top_issues"] = f"""WITH {DIRTY_CTE} {ISSUES}
SELECT priority, severity, dimension, rule_id, n_records, reason FROM issues ORDER BY priority LIMIT 5"""
ORACLES["issues_by_severity"] = f"""WITH {DIRTY_CTE} {ISSUES}
SELECT priority, rule_id, severity FROM issues WHERE severity IN ('critical', 'high')"""
ORACLES["issue_sample_keys"] = f"""WITH {DIRTY_CTE} found AS ({findings('orders', 'dirty', HEADER_RULES, 'o_orderkey')})
SELECT rule_id, array_to_string(list(row_key ORDER BY CAST(row_key AS BIGINT))[1:10], ',') AS record_keys
FROM found GROUP BY 1"""
ORACLES["findings_per_rule"] = f"""WITH {DIRTY_CTE} found AS ({findings('orders', 'dirty', HEADER_RULES, 'o_orderkey')})
SELECT "table", rule_id, dimension, count(*) AS n_findings, count(DISTINCT row_key) AS n_rows FROM found GROUP BY 1, 2, 3"""

_FLAGGED = """
WITH t AS (SELECT quantile_cont(o_totalprice, 0.995) AS t, median(o_totalprice) AS m, count(*) AS n FROM orders),
ranked AS (SELECT o_orderkey, o_totalprice AS s, t, m, n,
             (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / n AS pct,
             count(*) FILTER (WHERE o_totalprice < t) OVER () / n AS below,
             count(*) FILTER (WHERE o_totalprice >= t) OVER () AS flagged,
             row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders, t)"""
ORACLES["anomaly_issues"] = f"""{_FLAGGED},
conf AS (SELECT *, greatest(0.0, least(1.0, (pct - below) / greatest(1e-9, 1 - below))) AS c FROM ranked WHERE s >= t AND pos <= 200),
listed AS (
  SELECT format('ISS-A{{:04d}}', pos) AS issue_id, 100 * (0.27 + 0.30 * sqrt(1.0 / n) + 0.25 * c) AS sev,
         'record' AS scope, 'anomaly.price' AS rule_id, 1 AS n_records, 1.0 / n AS p,
         regexp_replace('Anomaly score ' || CAST(CAST(round(s) AS BIGINT) AS VARCHAR), '^$', '') AS head,
         'Anomaly score ' || CASE WHEN s < 99999.5 THEN 'x' ELSE format('{{:.5g}}', s) END || ' ('
           || format('{{:.4f}}', 100 * pct) || '% percentile, ' || format('{{:.1f}}', s / m) || 'x the batch median).' AS reason,
         {quoted(FAMILY_ACTIONS['anomaly'])} AS action, CAST(o_orderkey AS VARCHAR) AS keys FROM conf
  UNION ALL
  SELECT 'ISS-A0000', 40.0, 'dataset', 'anomaly.price.truncated', flagged - 200, (flagged - 200) / n, '',
         format('{{:,}}', flagged - 200) || ' further records exceeded the anomaly threshold but were not listed individually (register capped at 200).',
         {quoted(TRUNCATED_ACTION)}, '' FROM ranked WHERE pos = 1 AND flagged > 200)
SELECT issue_id, CAST(row_number() OVER (ORDER BY sev DESC, n_records DESC, rule_id, keys) AS INTEGER) AS priority,
       CASE WHEN issue_id = 'ISS-A0000' THEN 'medium' WHEN sev >= 75 THEN 'critical' WHEN sev >= 50 THEN 'high'
            WHEN sev >= 25 THEN 'medium' ELSE 'low' END AS severity,
       round(sev, 2) AS severity_score, 'anomaly_model' AS source, 'anomaly' AS dimension, rule_id, scope,
       'orders' AS "table", CAST(NULL AS VARCHAR) AS "column", CAST(n_records AS BIGINT) AS n_records,
       round(p, 6) AS pct_affected, reason, action AS recommended_action, keys AS record_keys FROM listed"""
ORACLES["anomaly_issues"] = ORACLES["anomaly_issues"].replace(
    """         regexp_replace('Anomaly score ' || CAST(CAST(round(s) AS BIGINT) AS VARCHAR), '^$', '') AS head,
""", "").replace("CASE WHEN s < 99999.5 THEN 'x' ELSE format('{:.5g}', s) END", "format('{:.5g}', s)").replace(
    "(flagged - 200) / n, '',", "(flagged - 200) / n,")
ORACLES["anomaly_summary"] = f"""{_FLAGGED}
SELECT 'price' AS model, any_value(n) AS n_scored, any_value(flagged) AS n_flagged,
       round(any_value(flagged) / any_value(n), 6) AS flag_rate, round(any_value(t), 6) AS threshold_value,
       '99.50th percentile of unlabelled calibration scores' AS threshold_rule, round(any_value(m), 6) AS score_median,
       max(s) AS score_max FROM ranked"""


# --- profiles ---------------------------------------------------------------------------


def inferred(source: str, columns: list[tuple[str, str]], key_candidates: list[str], ctes: str = "") -> str:
    """Columns as (name, dtype); a key is the first column without gaps and repeats."""
    first_key = "CASE " + " ".join(
        f"WHEN (SELECT count(*) = count({c}) AND count(*) = count(DISTINCT {c}) FROM {source}) THEN '{c}'"
        for c in key_candidates) + " END"
    rows = []
    for i, (c, dtype) in enumerate(columns):
        low = high = "CAST(NULL AS DOUBLE)"
        words, outlier = "CAST(NULL AS VARCHAR)", "FALSE"
        if dtype in ("int", "float"):
            q = [f"quantile_cont(CAST({c} AS DOUBLE), {p})" for p in (0.001, 0.999)]
            low = f"round({q[0]} - 0.2 * greatest(abs({q[1]} - {q[0]}), 1e-9), 6)"
            high = f"round({q[1]} + 0.2 * greatest(abs({q[1]} - {q[0]}), 1e-9), 6)"
            outlier = f"count({c}) > 20"
        if dtype == "string":
            words = (f"CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 20 "
                     f"THEN array_to_string(list(DISTINCT {c} ORDER BY {c}), ',') END")
        rows.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name, '{dtype}' AS dtype, 1 - count({c}) / count(*) < 0.5 AS required, "
            f"least(1.0, round(1 - count({c}) / count(*) + 0.02, 4)) AS max_null_rate, {low} AS min, {high} AS max, "
            f"{words} AS allowed_values, {outlier} AS outlier, coalesce('{c}' = ({first_key}), FALSE) AS primary_key "
            f"FROM {source}")
    return (f"WITH {ctes} " if ctes else "") + " UNION ALL ".join(rows)


ORACLES["inferred_profile"] = inferred(
    "customer", [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                 ("c_mktsegment", "string")], ["c_custkey"])
ORACLES["inferred_profile_orders"] = inferred(
    "dirty", [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "string"),
              ("o_orderdate", "datetime"), ("o_orderpriority", "string"), ("o_duedate", "datetime"),
              ("o_netprice", "float"), ("o_segment", "string")], HEADER_COLUMNS, DIRTY_CTE.rstrip(", "))
ORACLES["detected_profile"] = "SELECT 'creditcard_transactions' AS profile, count(*) AS n_rows FROM embeddings"

_CARD_FEATURES = {f"V{i}": f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 29)}
_AMOUNT = "(abs(CAST(embedding[29] AS DOUBLE)) * 100)"
CARD = ("SELECT vec_id, vec_id * 61.0 AS Time, " + ", ".join(f"{e} AS {n}" for n, e in _CARD_FEATURES.items())
        + f", {_AMOUNT} AS Amount, CAST(label = 0 AS INTEGER) AS Class FROM embeddings")
_CARD_RULES = [
    *[null_rule(c) for c in ("Time", *_CARD_FEATURES)], null_rule("Amount", 2.0),
    null_rule("Class", 1.0, 1.0, 0.4),
    *[type_rule(c, "float", c) for c in ("Time", *_CARD_FEATURES)], type_rule("Amount", "float", "Amount", 2.0),
    type_rule("Class", "int", "Class"),
    range_rule("Time", "Time", 0.0, None), *[range_rule(c, c, -100.0, 100.0) for c in _CARD_FEATURES],
    range_rule("Amount", "Amount", 0.0, None, 2.0), range_rule("Class", "Class", 0.0, 1.0),
    Rule("expect_table_rows_to_be_unique", "uniqueness", None,
         "row_number() OVER (PARTITION BY vec_id, Time, Amount, V1) > 1", 0.7, 1.0, ""),
    outlier_rule("Amount", "Amount", 5.0, "card"),
]
ORACLES["card_quality_score"] = summary(
    "creditcard_transactions", "card",
    tally("card", _CARD_RULES).replace(f"/ {1.0 - 1.0}", "/ 1e-9"), 32, CARD_WEIGHTS,
    ctes=f"card AS MATERIALIZED ({CARD}), ")


# --- defects ----------------------------------------------------------------------------

_TEXTED = {"TYPE_MISMATCH", "INVALID_CATEGORY", "INVALID_UOM", "BROKEN_FK", "ENCODING_NOISE"}


def _spread(u: str, low: float, high: float) -> str:
    return f"({low} + {u} * {high - low})"


def _changed(spec, u: str, texted: bool) -> str:
    c = spec.column
    x = number(c) if texted else c
    words = "[" + ", ".join(quoted(w) for w in spec.pool) + "]"
    others = f"list_filter({words}, lambda w: w IS DISTINCT FROM {c})"
    return {
        "MISSING_CRITICAL": lambda: "NULL",
        "MISSING_OPTIONAL": lambda: "NULL",
        "TYPE_MISMATCH": lambda: f"coalesce(translate(format('{{:,.2f}}', {x}), ',.', '.,'), 'nan')",
        "NEGATIVE_QUANTITY": lambda: f"-abs({x})",
        "ZERO_PRICE": lambda: "CAST(0 AS DOUBLE)",
        "OUT_OF_RANGE_PRICE": lambda: f"round({x} * {_spread(u, 50.0, 500.0)}, 2)",
        "INVALID_CATEGORY": lambda: f"{words}[CAST(floor({u} * {len(spec.pool)}) AS INTEGER) + 1]",
        "INVALID_UOM": lambda: f"{others}[CAST(floor({u} * len({others})) AS INTEGER) + 1]",
        "BROKEN_FK": lambda: f"'MAT-9' || CAST(CAST(floor({_spread(u, 10000.0, 99999.0)}) AS INTEGER) AS VARCHAR)",
        "ARITHMETIC_INCONSISTENCY": lambda: f"round({x} * {_spread(u, 1.05, 1.40)}, 2)",
        "DATE_ORDER_VIOLATION": lambda: f"{spec.base} - to_days(CAST(floor({_spread(u, 5.0, 120.0)}) AS INTEGER))",
        "FUTURE_DATE": lambda: f"TIMESTAMP '{B.TODAY}' + to_days(CAST(floor({_spread(u, 365.0, 1825.0)}) AS INTEGER))",
        "ENCODING_NOISE": lambda: f"""CASE WHEN instr({c}, 'E') > 0 THEN substr({c}, 1, instr({c}, 'E') - 1) || 'Ã©'
            || substr({c}, instr({c}, 'E') + 1) ELSE {c} END || '   '""",
    }[spec.code]()


def _chain(name: str, source: str, columns: list[str]) -> tuple[list[str], list[str]]:
    """CTEs that corrupt one table family by family, and the ledger selects."""
    key, steps, ledger = B.KEYS[name], [], []
    texted: set[str] = set()
    before = f"{name}_0"
    steps.append(f"{before} AS MATERIALIZED (SELECT *, 0 AS copy FROM {source})")
    for i, spec in enumerate(B.SPECS):
        if spec.table != name:
            continue
        d = draw(f"CAST({key} AS VARCHAR)", "copy", quoted(spec.code), str(B.SEED))
        u = uniform(f"CAST({key} AS VARCHAR)", "copy", quoted(spec.code), "'value'", str(B.SEED))
        is_text = spec.column in texted
        eligible = "TRUE"
        if spec.code == "NEGATIVE_QUANTITY":
            eligible = f"{number(spec.column) if is_text else spec.column} IS NOT NULL"
        if spec.code == "ZERO_PRICE":
            eligible = f"{spec.column} IS NOT NULL"
        hit, after = f"{name}_h{i}", f"{name}_{i + 1}"
        steps.append(
            f"{hit} AS MATERIALIZED (SELECT *, ok AND row_number() OVER (PARTITION BY ok ORDER BY d) <= "
            f"greatest(1, round_even(total * {spec.rate}, 0)) AS hit FROM (SELECT *, {d} AS d, ({eligible}) AS ok, "
            f"count(*) OVER () AS total FROM {before}))")
        head = f"SELECT {i} AS family, CAST({key} AS VARCHAR) AS row_key, copy"
        if spec.code == "DUPLICATE_ROW":
            listed = ", ".join(columns)
            steps.append(f"{after} AS MATERIALIZED (SELECT {listed}, copy FROM {hit} UNION ALL "
                         f"SELECT {listed}, copy + 1 FROM {hit} WHERE hit)")
            ledger.append(f"{head} + 1 AS copy, CAST({key} AS VARCHAR) AS a, CAST({key} AS VARCHAR) AS b FROM {hit} WHERE hit"
                          .replace("copy + 1 AS copy", "copy + 1 AS copy"))
        else:
            new = _changed(spec, u, is_text)
            if spec.code in _TEXTED:
                texted.add(spec.column)
            if spec.column in texted:
                old, new = f"CAST({spec.column} AS VARCHAR)", f"CAST({new} AS VARCHAR)"
            else:
                old = spec.column
            listed = ", ".join(f"CASE WHEN hit THEN {new} ELSE {old} END AS {c}" if c == spec.column else c
                               for c in columns)
            steps.append(f"{after} AS MATERIALIZED (SELECT {listed}, copy FROM {hit})")
            ledger.append(f"{head}, coalesce(CAST({spec.column} AS VARCHAR), '') AS a, "
                          f"coalesce(CAST({new} AS VARCHAR), '') AS b FROM {hit} WHERE hit")
        before = after
    steps.append(f"dirty_{name} AS MATERIALIZED (SELECT {', '.join(columns)} FROM {before})")
    return steps, ledger


_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CHAINS = [_chain("orders", f"({CLEAN_HEADERS})", HEADER_COLUMNS), _chain("part", "part", _PART_COLUMNS),
           _chain("customer", "customer", _CUSTOMER_COLUMNS)]
_FAMILIES = ", ".join(
    f"({i}, '{s.table}', {quoted(s.column) if s.column else 'NULL'}, '{s.code}', '{s.dimension}')"
    for i, s in enumerate(B.SPECS))
INJECTED = ",\n".join(step for steps, _ in _CHAINS for step in steps) + f""",
ledger AS MATERIALIZED (SELECT format('DEF-{{:06d}}', row_number() OVER (ORDER BY l.family, row_key, copy)) AS defect_id,
  f."table", row_key, f."column", f.defect_code, f.dimension, a AS original_value, b AS corrupted_value
  FROM ({" UNION ALL ".join(s for _, ledger in _CHAINS for s in ledger)}) l
  JOIN (VALUES {_FAMILIES}) f(family, "table", "column", defect_code, dimension) ON f.family = l.family)"""

ORACLES["injected_ledger"] = f"WITH {INJECTED} SELECT * FROM ledger"
ORACLES["dirty_table"] = (f"WITH {INJECTED} SELECT "
                          + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in HEADER_COLUMNS) + " FROM dirty_orders")
ORACLES["changed_cells"] = f"WITH {INJECTED} " + " UNION ALL ".join(
    f"SELECT CAST(a.p_partkey AS VARCHAR) AS row_key, '{c}' AS \"column\", CAST(a.{c} AS VARCHAR) AS before, "
    f"CAST(b.{c} AS VARCHAR) AS after FROM part a JOIN dirty_part b ON a.p_partkey = b.p_partkey "
    f"WHERE a.{c} IS DISTINCT FROM b.{c}" for c in _PART_COLUMNS[1:])

_ORDER_RULES = header_rules("dirty_orders", "dirty_customer", number("o_custkey"))
MEASURED = f"""{INJECTED},
found AS MATERIALIZED (SELECT * FROM ({findings('orders', 'dirty_orders', _ORDER_RULES, 'o_orderkey')})
  UNION ALL SELECT * FROM ({findings('part', 'dirty_part', part_rules('dirty_part'), 'p_partkey')})
  UNION ALL SELECT * FROM ({findings('customer', 'dirty_customer', customer_rules(), 'c_custkey')})),
recall AS (SELECT l."table", l.defect_code, count(*) AS injected,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM found f WHERE f."table" = l."table" AND f.row_key = l.row_key
      AND (l."column" IS NULL OR f."column" IS NULL OR f."column" = l."column"))) AS detected
  FROM ledger l GROUP BY 1, 2),
precision AS (SELECT f."table", rule_id, dimension, count(*) AS flagged,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ledger l WHERE l."table" = f."table" AND l.row_key = f.row_key)) AS true_positives
  FROM found f GROUP BY 1, 2, 3)"""
ORACLES["defect_recall"] = f"WITH {MEASURED} SELECT *, round(detected / injected, 4) AS recall FROM recall"
ORACLES["rule_precision"] = f"""WITH {MEASURED} SELECT *, round(true_positives / flagged, 4) AS precision,
  dimension = 'plausibility' AS is_statistical FROM precision"""
ORACLES["engine_summary"] = f"""WITH {MEASURED}
SELECT CAST(sum(injected) AS BIGINT) AS defects_injected, CAST(sum(detected) AS BIGINT) AS defects_detected,
       round(sum(detected) / sum(injected), 4) AS overall_recall,
       count(*) FILTER (WHERE round(detected / injected, 4) = 1.0) AS families_at_full_recall, count(*) AS n_families,
       (SELECT round(sum(true_positives) / sum(flagged), 4) FROM precision WHERE dimension <> 'plausibility')
         AS deterministic_rule_precision
FROM recall"""
ORACLES["dirty_quality_scores"] = f"WITH {INJECTED} " + " UNION ALL ".join(
    f"SELECT * FROM ({summary(t, 'dirty_' + t, tally('dirty_' + t, rules), n, digits=4)})" for t, rules, n in (
        ("orders", _ORDER_RULES, 9), ("part", part_rules("dirty_part"), 6), ("customer", customer_rules(), 5)))


# --- features, thresholds, metrics ------------------------------------------------------

_FEATURES = {
    **{n: n for n in _CARD_FEATURES},
    "log_amount": "ln(1 + greatest(Amount, 0))",
    "hour_sin": "sin(2 * pi() * fmod(Time / 3600.0, 24.0) / 24.0)",
    "hour_cos": "cos(2 * pi() * fmod(Time / 3600.0, 24.0) / 24.0)",
}
ORACLES["feature_matrix"] = (f"SELECT vec_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _FEATURES.items())
                             + f" FROM ({CARD})")
ORACLES["scaler_parameters"] = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg({e}), 6) AS mean, round(stddev_pop({e}), 6) AS deviation "
    f"FROM ({CARD}) WHERE Class = 0" for n, e in _FEATURES.items())
ORACLES["temporal_split_counts"] = """
WITH placed AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(user_id) AS BIGINT) AS user_sum,
       CASE WHEN i < CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * (0.6 + 0.2)) AS BIGINT)
            THEN 'calibration' ELSE 'test' END AS part
FROM placed GROUP BY part"""
SCORED = ("SELECT o_orderkey, o_totalprice AS score, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS label FROM orders")
DOCS = "SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM labels JOIN documents USING (doc_id)"


def threshold(name: str, p: float, rule: str, rate: str) -> str:
    return (f"SELECT '{name}' AS name, round(quantile_cont(o_totalprice, {p}), 6) AS value, '{rule}' AS rule, "
            f"{rate} AS expected_flag_rate, FALSE AS is_oracle FROM orders")


ORACLES["review_budget_threshold"] = threshold(
    "budget@0.50%", 0.995, "99.50th percentile of unlabelled calibration scores", "CAST(0.005 AS DOUBLE)")
ORACLES["train_percentile_threshold"] = threshold(
    "train_p99", 0.99, "99th percentile of training reconstruction error", "round(CAST(0.01 AS DOUBLE), 6)")


def steps(scored: str) -> str:
    return f"""SELECT score, n, pos, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER () AS all_n,
  sum(pos) OVER () AS all_pos FROM (SELECT score, count(*) AS n, sum(label) AS pos FROM ({scored}) GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC)"""


def best_cut(scored: str) -> str:
    return (f"(SELECT score FROM ({steps(scored)}) ORDER BY 2 * cum_pos / (cum_n + all_pos) DESC, score LIMIT 1)")


ORACLES["best_f1_threshold"] = f"""
SELECT 'best_f1_oracle' AS name, round(score, 6) AS value,
       'argmax F1 over labelled test scores (uses labels; not deployable)' AS rule,
       round(cum_n / all_n, 6) AS expected_flag_rate, TRUE AS is_oracle
FROM ({steps(SCORED)}) ORDER BY 2 * cum_pos / (cum_n + all_pos) DESC, score LIMIT 1"""
ORACLES["pr_curve"] = f"""
SELECT score, CAST(cum_pos AS BIGINT) AS tp, CAST(cum_n - cum_pos AS BIGINT) AS fp, round(cum_pos / cum_n, 6) AS precision,
       round(cum_pos / all_pos, 6) AS recall, round((cum_n - cum_pos) / (all_n - all_pos), 6) AS fpr FROM ({steps(SCORED)})"""


def ranking(scored: str) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(pos) AS BIGINT) AS n_positives,
  sum(pos) / sum(n) AS prevalence,
  sum((n - pos) * (cum_pos - pos + pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS roc_auc,
  sum(pos * cum_pos / cum_n) / sum(pos) AS pr_auc FROM ({steps(scored)})"""


ORACLES["average_precision"] = f"""SELECT n_records, n_positives, round(prevalence, 6) AS prevalence,
  round(pr_auc, 6) AS pr_auc, round(pr_auc / prevalence, 6) AS pr_auc_lift FROM ({ranking(DOCS)})"""
ORACLES["roc_auc"] = f"SELECT n_records, round(roc_auc, 6) AS roc_auc FROM ({ranking(SCORED)})"


def confusion(scored: str, cut: str) -> str:
    return f"""SELECT *, true_positives + false_positives AS alerts,
  (true_positives + false_positives) / all_rows AS flag_rate,
  CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS precision,
  true_positives / (true_positives + false_negatives) AS recall,
  2 * true_positives / (2 * true_positives + false_positives + false_negatives) AS f1,
  (true_positives + false_positives) * 90 / 3600 AS review_hours,
  CASE WHEN true_positives > 0 THEN false_positives / true_positives ELSE 'inf'::DOUBLE END AS false_positives_per_true_positive,
  CASE WHEN true_positives > 0 THEN (true_positives + false_positives) * 90 / 3600 / true_positives ELSE 'inf'::DOUBLE END AS review_hours_per_fraud_found,
  1000 * (true_positives + false_positives) / all_rows AS alerts_per_1000_records
FROM (SELECT count(*) FILTER (WHERE score >= t AND label = 1) AS true_positives,
             count(*) FILTER (WHERE score >= t AND label = 0) AS false_positives,
             count(*) FILTER (WHERE score < t AND label = 1) AS false_negatives,
             count(*) FILTER (WHERE score < t AND label = 0) AS true_negatives, count(*) AS all_rows
      FROM (SELECT *, {cut} AS t FROM ({scored})))"""


def budget(scored: str, share: float) -> str:
    return f"(SELECT quantile_cont(score, {1.0 - share}) FROM ({scored}))"


_COUNTS = "true_positives, false_positives, false_negatives, true_negatives, alerts"
_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in ("flag_rate", "precision", "recall", "f1"))
ORACLES["confusion_metrics"] = f"SELECT {_COUNTS}, {_RATES} FROM ({confusion(SCORED, budget(SCORED, 0.05))})"
ORACLES["reviewer_workload"] = f"""SELECT alerts, round(review_hours, 6) AS review_hours,
  round(false_positives_per_true_positive, 6) AS false_positives_per_true_positive,
  round(review_hours_per_fraud_found, 6) AS review_hours_per_fraud_found,
  round(alerts_per_1000_records, 6) AS alerts_per_1000_records FROM ({confusion(SCORED, budget(SCORED, 0.05))})"""
ORACLES["caught_positives"] = f"""SELECT CAST(sum(label) AS BIGINT) AS n_labelled_positives,
  count(*) FILTER (WHERE label = 1 AND score >= {budget(SCORED, 0.005)}) AS n_caught FROM ({SCORED})"""
ORACLES["precision_at_k"] = f"""
WITH ranked AS (SELECT label, row_number() OVER (ORDER BY score DESC, o_orderkey) AS r, count(*) OVER () AS n FROM ({SCORED})),
ks AS (SELECT DISTINCT CAST(least(k, (SELECT count(*) FROM orders)) AS INTEGER) AS k FROM (VALUES (50), (100), (285), (500), (1000)) v(k))
SELECT k, CAST(sum(label) FILTER (WHERE r <= k) AS BIGINT) AS hits, round(sum(label) FILTER (WHERE r <= k) / k, 6) AS precision,
       round(sum(label) FILTER (WHERE r <= k) / greatest(1, sum(label)), 6) AS recall FROM ranked, ks GROUP BY k"""
ORACLES["budget_sweep"] = " UNION ALL ".join(
    f"SELECT 'budget@{b:.2%}' AS threshold_name, CAST({b} AS DOUBLE) AS budget, round({budget(SCORED, b)}, 6) AS threshold_value, "
    f"{_COUNTS}, {_RATES} FROM ({confusion(SCORED, budget(SCORED, b))})" for b in (0.001, 0.005, 0.01, 0.02))

_MODELS = {
    "price": SCORED,
    "cheapness": f"SELECT o_orderkey, -score AS score, label FROM ({SCORED})",
    "random": f"SELECT o_orderkey, {uniform('o_orderkey', quoted('random'), '42')} AS score, label FROM ({SCORED})",
}


def compared(oracle: bool = False) -> str:
    name = "best_f1_oracle" if oracle else "budget@0.50%"
    return " UNION ALL ".join(f"""
SELECT '{m}' AS model, r.pr_auc, r.pr_auc / r.prevalence AS pr_auc_lift, r.roc_auc, c.precision, c.recall, c.f1, c.alerts,
  c.true_positives, c.false_positives, c.false_negatives,
  (SELECT sum(label) / count(*) FROM (SELECT label FROM ({s}) ORDER BY score DESC, o_orderkey LIMIT 100)) AS precision_at_100,
  c.review_hours, c.review_hours_per_fraud_found, '{name}' AS threshold_name, {str(oracle).upper()} AS threshold_is_oracle
FROM ({ranking(s)}) r, ({confusion(s, best_cut(s) if oracle else budget(s, 0.005))}) c""" for m, s in _MODELS.items())


_COMPARED_DOUBLES = ("pr_auc", "pr_auc_lift", "roc_auc", "precision", "recall", "f1", "precision_at_100", "review_hours",
                     "review_hours_per_fraud_found")
ORACLES["model_comparison"] = (
    "SELECT model, alerts, true_positives, false_positives, false_negatives, threshold_name, threshold_is_oracle, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _COMPARED_DOUBLES) + f" FROM ({compared()})")
ORACLES["oracle_overstatement"] = f"""
SELECT a.model, round(a.f1, 6) AS honest_f1, round(b.f1, 6) AS oracle_f1, round(b.f1 - a.f1, 6) AS overstatement
FROM ({compared()}) a JOIN ({compared(True)}) b ON a.model = b.model"""
ORACLES["score_histogram"] = f"""
WITH logs AS (SELECT log10(score) AS x, label FROM ({SCORED}) WHERE score > 0),
ends AS (SELECT min(x) AS low, (max(x) - min(x)) / 70 AS width FROM logs)
SELECT CAST(least(69, greatest(0, floor((x - low) / width))) AS INTEGER) AS bin, label, count(*) AS n FROM logs, ends GROUP BY 1, 2"""


def replicates(scored: str, key: str, cut: str, resamples: int = 200, seed: int = 42) -> str:
    u = "('0x' || substr(md5(concat_ws(':', CAST({k} AS VARCHAR), r // 3, {s})), CAST(8 * (r % 3) + 1 AS INTEGER), 8))::BIGINT / 4294967296.0"
    u = u.format(k=key, s=seed)
    # distribution function of Poisson(1)
    steps = accumulate(math.exp(-1) / math.factorial(k) for k in range(10))
    weight = " + ".join(f"CAST(u >= {s!r}::DOUBLE AS INTEGER)" for s in steps)
    return f"""
WITH drawn AS (SELECT score, label, r, {u} AS u FROM ({scored}), range({resamples}) t(r)),
weighted AS (SELECT r AS replicate, score, sum({weight}) AS n, sum(({weight}) * label) AS pos FROM drawn GROUP BY 1, 2),
placed AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM weighted WHERE n > 0
           WINDOW w AS (PARTITION BY replicate ORDER BY score DESC))
SELECT CAST(replicate AS INTEGER) AS replicate, sum(pos * cum_pos / cum_n) / sum(pos) AS pr_auc,
       coalesce(sum(pos) FILTER (WHERE score >= {cut}), 0) / sum(pos) AS recall, CAST(sum(pos) AS BIGINT) AS positives
FROM placed GROUP BY 1 HAVING sum(pos) > 0"""


ORACLES["bootstrap_replicates"] = f"""SELECT replicate, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, positives
FROM ({replicates(DOCS, 'doc_id', '2000.0')})"""
ORACLES["bootstrap_interval"] = f"""
SELECT round(quantile_cont(pr_auc, 0.025), 6) AS pr_auc_low, round(quantile_cont(pr_auc, 0.975), 6) AS pr_auc_high,
       round(quantile_cont(recall, 0.025), 6) AS recall_low, round(quantile_cont(recall, 0.975), 6) AS recall_high,
       count(*) AS n_resamples
FROM ({replicates(DOCS, 'doc_id', budget(DOCS, 0.1))})"""


# --- looking at labelled data, sources --------------------------------------------------

_LINES = "(SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS returned FROM lineitem)"
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORACLES["class_counts"] = f"""SELECT returned AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share
FROM {_LINES} GROUP BY 1"""
ORACLES["missing_totals"] = with_dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM dirty" for c in HEADER_COLUMNS))
ORACLES["class_separation"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(avg({c}) FILTER (WHERE returned = 1) - avg({c}) FILTER (WHERE returned = 0)) "
    f"/ stddev_samp({c}), 6) AS separation FROM {_LINES}" for c in _NUMBERS)
_DEVIATIONS = ", ".join(f"stddev_samp({c})" for c in _NUMBERS)
ORACLES["deviation_spread"] = (f"SELECT round(least({_DEVIATIONS}), 4) AS min_std, "
                               f"round(greatest({_DEVIATIONS}), 4) AS max_std FROM lineitem")
ORACLES["class_describe"] = f"""
SELECT label AS class, count(score) AS n, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std, min(score) AS min,
       round(quantile_cont(score, 0.25), 4) AS p25, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.75), 4) AS p75, max(score) AS max
FROM ({DOCS}) GROUP BY 1"""
ORACLES["hour_density"] = """
WITH placed AS (SELECT CAST(least(47, floor((hour(ts) + minute(ts) / 60) / 0.5)) AS INTEGER) AS bin,
                       CAST(event_type = 'error' AS INTEGER) AS class FROM events)
SELECT bin, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY class) / 0.5, 6) AS density
FROM placed GROUP BY 1, 2"""
ORACLES["most_recent_rows"] = "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"
ORACLES["source_contract"] = "SELECT toxic, count(*) AS n FROM labels GROUP BY 1"
_STRICT = {
    "expect_column_values_to_be_between.l_quantity": "l_quantity > 45", "expect_column_values_to_be_between.l_discount": "l_discount > 0.08",
    "expect_column_values_to_be_in_set.l_returnflag": "l_returnflag NOT IN ('A', 'N')", "expect_column_to_exist.l_shipmode": "true",
}
ORACLES["findings_partitioned"] = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, count(*) AS n_findings, count(*) AS n_positions FROM lineitem WHERE {failed} HAVING count(*) > 0"
    for rule, failed in _STRICT.items()) + """ UNION ALL SELECT 'expect_table_rows_to_be_unique', sum(n - 1)::BIGINT, sum(n - 1)::BIGINT
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag) HAVING sum(n - 1) > 0"""
ORACLES["csv_round_trip"] = "SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, round(p_retailprice, 6) AS p_retailprice, true AS gapless FROM part"
ORACLES["top_scored_rows"] = """SELECT o_totalprice AS anomaly_score, * EXCLUDE (o_orderdate) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"""

# --- reports, models --------------------------------------------------------------------

_SCORED = f"scored AS ({ORACLES['batch_quality_score']})"
ORACLES["report_document"] = f"""WITH {_SCORED}, dims AS ({ORACLES['dimension_scores']}), issues AS ({ORACLES['issue_register']})
SELECT 'orders-1' AS batch_id, s."table", s.n_rows, s.n_columns, round(s.global_score, 2) AS global_score, s.grade, s.profile_inferred,
  (SELECT count(*) FROM issues) AS n_issues, d.dimension, d.score, d.weight, d.rules AS rules_evaluated, d.failed_rules AS rules_failed,
  {', '.join(f"(SELECT count(*) FROM issues WHERE severity = '{x}') AS n_{x}" for x in ('critical', 'high', 'medium', 'low'))}
FROM scored s, dims d"""
ORACLES["report_issues"] = f"""WITH issues AS ({ORACLES['issue_register']}), keys AS ({ORACLES['issue_sample_keys']})
SELECT issue_id, priority, severity, severity_score, rule_id, n_records, reason, coalesce(record_keys, '') AS record_keys
FROM issues LEFT JOIN keys USING (rule_id)"""
ORACLES["report_top_issues"] = ORACLES["top_issues"]
ORACLES["model_round_trip"] = """SELECT vec_id::VARCHAR AS row_key, true AS same_autoencoder, true AS same_forest, true AS same_scaler,
  (SELECT count(*) FROM embeddings) AS n_calibration FROM embeddings"""

# the set weights pass on the positive part of the first twelve of 31 features and drop the others
_CARD = [f"V{i}" for i in range(1, 29)] + ["log_amount", "hour_sin", "hour_cos"]
_VALUES = [f"embedding[{i}]::DOUBLE" for i in range(1, 29)] + [
    "ln(1 + greatest(abs(embedding[29]::DOUBLE) * 100, 0))", "sin((vec_id * 61.0 / 3600.0) % 24.0 * (2 * pi() / 24.0))",
    "cos((vec_id * 61.0 / 3600.0) % 24.0 * (2 * pi() / 24.0))"]
_SEEN = "[" + ", ".join(f"(({v}) / 0.25)::FLOAT::DOUBLE" for v in _VALUES) + "]"
ORACLES["explained_issues"] = f"""
WITH seen AS (SELECT vec_id, {_SEEN} AS x FROM embeddings),
rebuilt AS (SELECT vec_id, x, [CASE WHEN i <= 12 THEN greatest(x[i], 0) ELSE 0 END FOR i IN range(1, 32)] AS y FROM seen),
errors AS (SELECT vec_id, x, y, [(y[i] - x[i]) * (y[i] - x[i]) FOR i IN range(1, 32)] AS e FROM rebuilt),
scored AS (SELECT *, list_sum(e) / 31 AS s FROM errors),
t AS (SELECT quantile_cont(s, 0.98) AS t, median(s) AS m, count(*) AS n FROM scored),
ranked AS (SELECT *, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / n AS pct,
  row_number() OVER (ORDER BY s DESC, vec_id) AS pos, count(*) FILTER (WHERE s >= t) OVER () AS flagged FROM scored, t),
listed AS (SELECT * FROM ranked WHERE s >= t AND pos <= 200),
feature AS (SELECT vec_id, ([{', '.join(quoted(c) for c in _CARD)}])[i] AS f, x[i] AS o, y[i] AS p,
  row_number() OVER (PARTITION BY vec_id ORDER BY e[i] DESC, i) AS r FROM (SELECT *, unnest(range(1, 32)) AS i FROM listed)),
why AS (SELECT vec_id, string_agg(f, ',' ORDER BY r) AS features,
  string_agg(f || ' (observed ' || printf('%.2f', o) || ' vs expected ' || printf('%.2f', p) || ')', ', ' ORDER BY r) AS deviations FROM feature WHERE r <= 3 GROUP BY 1)
SELECT format('ISS-A{{:04d}}', pos) AS issue_id, 'anomaly.autoencoder' AS rule_id, 1::BIGINT AS n_records, (vec_id // 2)::VARCHAR AS record_keys, features,
  'Anomaly score ' || format('{{:.5g}}', s) || ' (' || format('{{:.4f}}', 100 * pct) || '% percentile, ' || format('{{:.1f}}', s / m)
    || 'x the batch median). Largest deviations: ' || deviations || '.' AS reason
FROM listed JOIN why USING (vec_id)
UNION ALL SELECT 'ISS-A0000', 'anomaly.autoencoder.truncated', (flagged - 200)::BIGINT, '', NULL,
  format('{{:,}}', flagged - 200) || ' further records exceeded the anomaly threshold but were not listed individually (register capped at 200).'
FROM ranked WHERE pos = 1 AND flagged > 200"""

# --- what must hold of fitted detectors: their numbers can't be computed here, their defining equations hold or not ---

ORACLES["pca_facts"] = """SELECT k::INT AS component, (SELECT count(*) FROM embeddings WHERE label <> 0) AS n, true AS unit, true AS orthogonal, true AS solves,
  true AS falling FROM range(1, 9) t(k)"""
ORACLES["logistic_facts"] = """SELECT count(*) AS n, count(*) FILTER (label = 0) AS positives, true AS gradient_vanishes, true AS classes_balanced FROM embeddings"""
ORACLES["forest_facts"] = """SELECT t::INT AS tree, least(8192, (SELECT count(*) FROM lineitem))::BIGINT AS sample, true AS drawn, true AS cuts_inside,
  true AS paths_bounded FROM range(200) r(t)"""
ORACLES["autoencoder_facts"] = """SELECT true AS same, true AS learns,
  (SELECT 2 * (w * 24 + 24 * 16 + 16 * 8) + 24 + 16 + 8 + 16 + 24 + w FROM (SELECT max(len(embedding)) AS w FROM embeddings))::BIGINT AS weights"""
ORACLES["set_forest_scores"] = """
WITH x AS (SELECT l_orderkey, [l_quantity::FLOAT::DOUBLE, l_extendedprice::FLOAT::DOUBLE, l_discount::FLOAT::DOUBLE, l_tax::FLOAT::DOUBLE] AS v FROM lineitem),
up AS (SELECT l_orderkey, [v[1] >= 25.0, v[2] >= 30000.0, v[3] >= 0.05, v[4] >= 0.04] AS u FROM x),
path AS (SELECT l_orderkey, list_sum([CASE WHEN u[t + 1] THEN CASE WHEN u[(t + 2) % 4 + 1] THEN 5 + t ELSE 4 END
  ELSE CASE WHEN u[(t + 1) % 4 + 1] THEN 3 ELSE 2 + t END END FOR t IN range(3)]) / 3.0 AS p FROM up),
norm AS (SELECT 2.0 * (ln(255.0) + 0.5772156649015329) - 2.0 * 255.0 / 256.0 AS c)
SELECT round(pow(2.0, -p / c), 9) AS score, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM path, norm GROUP BY 1"""
ORACLES["written_findings"] = f"SELECT rule_id, n_findings, n_rows FROM ({ORACLES['findings_per_rule']})"
ORACLES["loaded_profile_scores"] = ORACLES["completeness_scores"]
ORACLES["recent_sample"] = ORACLES["most_recent_rows"]
ORACLES["resolved_profiles"] = """
SELECT 'given' AS "case", 'part' AS profile, false AS inferred, 'p_partkey' AS primary_key, 6::BIGINT AS n_columns, 0::BIGINT AS n_notes, (SELECT count(*) FROM part) AS n_rows
UNION ALL SELECT 'bundled', 'creditcard_transactions', false, '', 31, 0, (SELECT count(*) FROM embeddings)
UNION ALL SELECT 'inferred', 'uploaded_batch', true, 'c_custkey', (SELECT count(*) FROM (DESCRIBE customer)), 1, (SELECT count(*) FROM customer)"""
