"""Integer vectors and exact totals for the operators on embeddings.

Components become floor(factor * x).  All sums and distances are 64-bit integers, so a table
whose components are too large for that ends with a clear error, never with a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.kernels import per_text

LARGEST = 1 << 27  # a component's magnitude stays below this
MOST_COMPONENTS = 64  # squared distances of as many stay below 2^63


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row's begin and end."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` components; shorter ones are filled up with zeros."""
    values, bounds = lists_of(column)
    sizes = np.diff(bounds)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(bounds[:-1], sizes)] = values
    return out


def integers(column: pa.Array, factor: int) -> tuple[np.ndarray, pa.Array]:
    """Rows whose vector is there and has only finite components, and those vectors as lists of integers."""
    values, bounds = lists_of(column)
    values = values.astype(np.float64)  # a null component is not a number
    usable = (per_text(~np.isfinite(values), bounds) == 0) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(usable)
    sizes = np.diff(bounds)
    whole = np.floor(factor * values[np.repeat(usable, sizes)])
    longest = max(int(sizes[rows].max(initial=0)), MOST_COMPONENTS)
    if np.abs(whole).max(initial=0) >= LARGEST // max(1, int(np.ceil(np.sqrt(longest / MOST_COMPONENTS)))):
        raise ValueError(f"a component times {factor} is too large for exact 64-bit distances")
    offsets = np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32)
    return rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.astype(np.int32)))


def vectors(df: DataFrame, columns: Sequence[str], factor: int) -> DataFrame:
    """The named columns and ``ints`` (array<int>) of the rows with a usable ``embedding``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ints = integers(batch.column("embedding"), factor)
            others = [batch.column(c).take(pa.array(rows)) for c in columns]
            yield pa.RecordBatch.from_arrays([*others, ints], [*columns, "ints"])

    narrow = df.select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))
    types = dict(narrow.dtypes)
    return narrow.mapInArrow(kept, ", ".join([*(f"`{c}` {types[c]}" for c in columns), "ints array<int>"]))


def partial_totals(totals: np.ndarray) -> pa.RecordBatch:
    """What one task adds up, by position; zeros are left out."""
    at = np.flatnonzero(totals)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals.ravel()[at])], ["at", "value"])


TOTALS = "at long, value long"


def added(partials: DataFrame, size: int) -> list[int]:
    """The exact totals of all tasks, ``size`` numbers."""
    out = [0] * size
    for at, value in partials.groupBy("at").agg(total("value")).collect():
        out[at] = int(value)
    return out


def total(column: str | Column) -> Column:
    """A sum of longs that cannot overflow."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)"))


def added_at(totals: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of values to the named row of totals."""
    np.add.at(totals.reshape(-1), (rows[:, None] * values.shape[1] + np.arange(values.shape[1])).ravel(), values.ravel())
