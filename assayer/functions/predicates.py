"""Row predicates written in a profile as Spark SQL text (P-EXPRCHECK).

Spark's own parser reads the text. What it found must be in the tables below, node
by node, so a profile reaches arithmetic and comparisons over the columns it
declares, ``abs``, ``round`` and ``power``, and nothing else: no other function,
subquery, window, field access or column. Operands come from the caller, already
coerced, so texts that hold numbers compare as numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import ParseException
from pyspark.sql import Column, SparkSession, functions as F

from assayer.functions.coerce import column


class PredicateError(ValueError):
    """The predicate uses something a profile may not use."""


def _divide(a: Column, b: Column) -> Column:
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, a / b).otherwise(infinite)


def _floor_mod(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.pmod(a, b)).when(b < 0, -F.pmod(-a, -b))


#: Nodes of Spark's expression tree that a predicate may hold, by class, with what they mean here.
ALLOWED_NODES: dict[str, Callable[..., Column]] = {
    "Add": lambda a, b: a + b, "Subtract": lambda a, b: a - b, "Multiply": lambda a, b: a * b,
    "Divide": _divide, "Remainder": _floor_mod, "UnaryMinus": lambda a: -a, "UnaryPositive": lambda a: a,
    "And": lambda a, b: a & b, "Or": lambda a, b: a | b, "Not": lambda a: ~a,
    "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b, "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b, "EqualTo": lambda a, b: a == b,
}
COMPARISONS = {"LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "EqualTo"}
#: Functions by name and number of arguments.
ALLOWED_FUNCTIONS: dict[tuple[str, int], Callable[..., Column]] = {
    ("abs", 1): F.abs, ("round", 1): lambda a: F.bround(a, 0), ("power", 2): F.pow, ("pow", 2): F.pow,
}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def _parsed(text: str):
    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("predicates are read by Spark and need an active session")
    try:
        return session._jsparkSession.sessionState().sqlParser().parseExpression(text.strip())
    except ParseException as error:
        raise PredicateError(f"cannot read predicate {text!r}: {error}") from error


def _name(node) -> str:
    if node.nameParts().size() != 1:
        raise PredicateError(f"{node.nameParts().mkString('.')} is not a plain column")
    return node.nameParts().apply(0)


def _literal(node) -> Column:
    text, kind = node.toString(), node.dataType().typeName()
    if kind in ("string", "boolean"):
        return F.lit(text if kind == "string" else text == "true")
    try:
        return F.lit(float(text))
    except ValueError as error:
        raise PredicateError(f"{text} is not allowed in a predicate") from error


def _call(node, resolve: Callable[[str], Column]) -> Column:
    args = _children(node)
    name = _name(node).lower()
    if node.isDistinct() or node.filter().isDefined() or node.ignoreNulls():
        raise PredicateError("functions take plain arguments")
    if (name, len(args)) == ("round", 2):
        if _kind(args[1]) != "Literal" or not args[1].toString().lstrip("-").isdigit():
            raise PredicateError("round takes a whole number of digits")
        return F.bround(_column_of(args[0], resolve), int(args[1].toString()))
    if (name, len(args)) not in ALLOWED_FUNCTIONS:
        raise PredicateError(f"only {sorted({n for n, _ in ALLOWED_FUNCTIONS})} may be called")
    return ALLOWED_FUNCTIONS[name, len(args)](*[_column_of(a, resolve) for a in args])


def _column_of(node, resolve: Callable[[str], Column]) -> Column:
    kind = _kind(node)
    if kind == "UnresolvedAttribute":
        return resolve(_name(node))
    if kind == "Literal":
        return _literal(node)
    if kind == "UnresolvedFunction":
        return _call(node, resolve)
    if kind not in ALLOWED_NODES:
        raise PredicateError(f"{kind} is not allowed in a predicate")
    children = _children(node)
    if kind in COMPARISONS and _kind(children[0]) in COMPARISONS:  # 0 <= a < b
        middle = _column_of(_children(children[0])[1], resolve)
        return _column_of(children[0], resolve) & ALLOWED_NODES[kind](middle, _column_of(children[1], resolve))
    return ALLOWED_NODES[kind](*[_column_of(c, resolve) for c in children])


def _names(node) -> Iterator[str]:
    if _kind(node) == "UnresolvedAttribute":
        yield _name(node)
    for child in _children(node):
        yield from _names(child)


def operands(text: str) -> list[str]:
    """Column names the predicate reads, each once, in order of appearance."""
    return list(dict.fromkeys(_names(_parsed(text))))


def predicate(text: str, resolve: Callable[[str], Column]) -> Column:
    """The predicate as a boolean column; ``resolve`` supplies each operand."""
    return _column_of(_parsed(text), resolve)


def check_predicate(text: str, names: set[str], rule_id: str = "") -> None:
    """Walk the predicate once over declared names only, before any job starts."""

    def declared(name: str) -> Column:
        if name not in names:
            raise PredicateError(f"rule {rule_id}: unknown column {name!r}")
        return column(name)

    predicate(text, declared)
