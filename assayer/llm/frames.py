"""Small helpers around Arrow batches and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Text bytes of one task when a table is dealt out anew.
SLICE_BYTES = 8 << 20


def texts(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str | Column) -> DataFrame:
    """Only what an operator reads, under fixed names, so that other columns can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def map_batches(df: DataFrame, body: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator | None],
                schema: str) -> DataFrame:
    """``body`` on every Arrow batch; it returns one batch, an iterator of them, or None."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = body(batch)
                if isinstance(made, pa.RecordBatch):
                    made = [made]
                for out in made or ():
                    if out.num_rows:
                        yield out
    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A batch from arrays and lists, in the order given; unsigned hashes become signed."""
    out = {}
    for name, values in columns.items():
        if isinstance(values, np.ndarray) and values.dtype == np.uint64:
            values = values.view(np.int64)
        out[name] = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.RecordBatch.from_pydict(out)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """One list per row from values laid end to end."""
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def flat(column: pa.Array, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), np.concatenate([[0], np.cumsum(sizes)])
