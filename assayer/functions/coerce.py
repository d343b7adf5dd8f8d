"""Tolerant conversions: a value that does not parse becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Spark's cast also takes suffixes such as "1.0d"; plain numbers only, as a CSV reader would.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Texts accepted as booleans, after trimming and lower-casing.
TRUE_TEXT = ("true", "1", "yes")
FALSE_TEXT = ("false", "0", "no")


def column(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def missing(value: Column, kind: T.DataType) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def as_text(value: Column) -> Column:
    return value.cast("string")


def as_number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))
    return F.lit(None).cast("double")


def as_timestamp(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(kind, T.NumericType):
        # numbers are nanoseconds since the epoch
        return F.timestamp_micros((as_number(value, kind) / 1000).try_cast("bigint"))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return value.try_cast("timestamp")
    return F.lit(None).cast("timestamp")


def as_flag(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return value
    lowered = F.lower(F.trim(as_text(value)))
    return F.when(lowered.isin(*TRUE_TEXT), F.lit(True)).when(lowered.isin(*FALSE_TEXT), F.lit(False))


def coerced(value: Column, kind: T.DataType, dtype: str) -> Column:
    """Convert to a profile dtype."""
    if dtype in ("int", "float"):
        return as_number(value, kind)
    if dtype == "datetime":
        return as_timestamp(value, kind)
    if dtype == "bool":
        return as_flag(value, kind)
    return value


def key_text(names: list[str]) -> Column:
    """Key columns joined by a pipe; a missing part shows as ``nan``."""
    return F.concat_ws("|", *[F.coalesce(as_text(column(n)), F.lit("nan")) for n in names])
