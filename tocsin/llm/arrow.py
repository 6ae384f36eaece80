"""Arrow batches inside tasks: raw text, and groups of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterable[pa.RecordBatch]


def kinds(df: DataFrame, columns: list[str]) -> str:
    """Schema text of some columns."""
    return ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in columns)


def whole_row(columns: list[str]) -> Column:
    """All columns as one struct: whatever a row brings along cannot clash with names used on the way."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


def unpacked(rows: pa.StructArray, columns: list[str], replaced: dict[str, pa.Array] | None = None) -> list[pa.Array]:
    """Columns of such structs, some replaced."""
    return [(replaced or {}).get(c, a) for c, a in zip(columns, rows.flatten())]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows, to bound what a task holds at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def groups(batches: Batches, *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by ``keys``, none of which is null.

    Yields tables that hold complete groups only, with the offsets at which
    they start (and the number of rows at the end). What is held back is the
    last group of the rows seen so far, so memory is one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(batch, keys)[-1])
        if not last and held and all(batch.column(k)[0] == held[0].column(k)[0] for k in keys):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
        if whole.num_rows:
            yield whole, np.append(_starts(whole, keys), whole.num_rows)
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, np.append(_starts(whole, keys), whole.num_rows)


def _starts(rows: pa.RecordBatch | pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        column = rows.column(k)
        changed = pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1))
        new |= np.asarray(changed, bool)
    return np.append(0, np.flatnonzero(new) + 1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes joined by links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
