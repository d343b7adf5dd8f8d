"""Row identity: a printable key and a sortable, unique position that survive re-execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import column, key_text
from assayer.session import settled

POSITION = "__position"
ROW_KEY = "__row_key"
INTERNAL = (POSITION, ROW_KEY)


#: Room for the rows of one file in a position.
FILE_ROWS = 1 << 33


def numbered_table(written: DataFrame) -> DataFrame:
    """Number the rows of a table that :func:`settled` wrote, by part number and row within the file.

    Both are properties of the files, so the numbers stay the same however a
    reader cuts them: with other split sizes, more executors, or in a repeated task.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    return written.select("*", (part * FILE_ROWS + F.col("_metadata.row_index")).alias(POSITION))


def with_position(df: DataFrame) -> DataFrame:
    """Keep the position the source gave; without one, write the rows once and number them."""
    return df if POSITION in df.columns else numbered_table(settled(df))


def with_identity(df: DataFrame, keys: list[str] | None, order: list[str] | None = None) -> DataFrame:
    """Add position and row key; ``order`` columns take precedence over the source order.

    The row key is made of the key columns when all are there, else of the order
    columns or the position.
    """
    df = with_position(df)
    has_key = bool(keys) and set(keys) <= set(df.columns)
    label = key_text(keys) if has_key else key_text(order) if order else _position_text(df)
    df = df.withColumn(ROW_KEY, label)
    if order:
        df = df.withColumn(POSITION, F.struct(*[column(n) for n in order], F.col(POSITION).alias("__source")))
    return df


def _position_text(df: DataFrame) -> Column:
    kind = df.schema[POSITION].dataType
    if kind.typeName() == "struct":
        return F.concat_ws(":", *[F.col(POSITION)[f.name].cast("string") for f in kind.fields if f.name != "path"])
    return F.col(POSITION).cast("string")


def data_columns(df: DataFrame) -> list[str]:
    """The batch's own columns."""
    return [c for c in df.columns if c not in INTERNAL]
