"""From Arrow batches of window arrays to numpy matrices and back.

A window is one row. Interpreted higher-order functions cost about 0.4 us per
sample and pass; a matrix operation over the rows of a batch is some fifty times
cheaper, so whole-window maths runs as Arrow functions over batches.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = np.ndarray
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bounded(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``most`` bytes or list items in the column, and at least one row."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    ends = np.cumsum(length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def tidy(run: Task) -> Task:
    """``run``, which at its end gives memory back to the system: a Python worker lives on
    through many tasks, and what its allocators keep counts as the executor's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return tidied


def same_length(batch: pa.Array) -> Iterator[tuple[np.ndarray, Matrix]]:
    """(row numbers, (rows, n) matrix) per window length; null and empty windows are left out."""
    lengths = np.asarray(batch.value_lengths().fill_null(0))
    for n in np.unique(lengths[lengths > 0]):
        where = np.flatnonzero(lengths == n)
        part = batch if len(where) == len(batch) else batch.take(pa.array(where))
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield where, flat.astype(np.float64).reshape(len(where), n)


def _three_axes(batch: pa.Array) -> Iterator[tuple[np.ndarray, Matrix]]:
    """As :func:`same_length` for three-axis windows, giving the L2 norm over the axes."""
    axes = np.asarray(batch.value_lengths().fill_null(0))
    have = np.flatnonzero(np.asarray(batch.is_valid()))
    if (axes[have] != 3).any():
        raise ValueError(f"expected 3 axes, got {sorted(set(axes[have].tolist()))}")
    if not len(have):
        return
    inner = batch.take(pa.array(have)).flatten()
    for where, matrix in same_length(inner):
        rows = have[where.reshape(-1, 3)[:, 0] // 3]
        yield rows, np.sqrt((matrix.reshape(len(rows), 3, -1) ** 2).sum(axis=1))


def lists(size: int, parts: list[tuple[np.ndarray, Matrix]]) -> pa.Array:
    if len(parts) == 1 and len(parts[0][0]) == size:
        matrix = parts[0][1]
        offsets = np.arange(size + 1, dtype=np.int32) * matrix.shape[1]
        return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(matrix).ravel())
    rows: list = [None] * size
    for where, matrix in parts:
        for i, row in zip(where, matrix):
            rows[i] = row
    return pa.array(rows, type=pa.list_(pa.float64()))


def _numbers(size: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    out, missing = np.zeros(size), np.ones(size, dtype=bool)
    for where, values in parts:
        out[where], missing[where] = values, False
    return pa.array(out, mask=missing)


def window_map(x: Column, fn: Callable[[Matrix], Matrix], axes: bool = False) -> Column:
    """``fn``: (rows, n) matrix -> (rows, m) matrix, as an array column."""
    split = _three_axes if axes else same_length

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        return lists(len(batch), [(where, fn(m)) for where, m in split(batch)])

    return run(x)


def window_number(x: Column, fn: Callable[[Matrix], np.ndarray]) -> Column:
    """``fn``: (rows, n) matrix -> one number per row."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        return _numbers(len(batch), [(where, fn(m)) for where, m in same_length(batch)])

    return run(x)


def window_struct(
    x: Column,
    fn: Callable[[Matrix], dict[str, np.ndarray]],
    names: list[str],
    arrays: tuple[str, ...] = (),
    axes: bool = False,
) -> Column:
    """``fn``: (rows, n) matrix -> named numbers (or arrays) per row, as a STRUCT column."""
    split = _three_axes if axes else same_length
    kinds = [f"`{n}`:{'array<double>' if n in arrays else 'double'}" for n in names]

    @F.arrow_udf(f"struct<{','.join(kinds)}>")
    def run(batch: pa.Array) -> pa.Array:
        parts = [(where, fn(m)) for where, m in split(batch)]
        missing = np.ones(len(batch), dtype=bool)
        for where, _ in parts:
            missing[where] = False
        children = [
            (lists if n in arrays else _numbers)(len(batch), [(w, out[n]) for w, out in parts])
            for n in names
        ]
        return pa.StructArray.from_arrays(children, names=names, mask=pa.array(missing))

    return run(x)


def kept_in_process(key: str, make: Callable[[], object]) -> object:
    """``make()``, once per Python process and key: later tasks of the process find the value again.

    Functions travel by value and lose their globals, so the value hangs on a module of its own. One
    value is kept: another key takes the place of the last.
    """
    kept = sys.modules.setdefault("_pulsemill_kept", types.ModuleType("_pulsemill_kept")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept["value"] = make()
        kept["key"] = key
    return kept["value"]


def window_model(x: Column, key: str, load: Callable[[], Callable[[Matrix], np.ndarray]], max_bytes: int) -> Column:
    """One number per row from the function that ``load()`` gives, loaded once per process.

    The function sees at most ``max_bytes`` of samples at a time, and at least one window.
    """

    def scored(batch: pa.Array, fn) -> pa.Array:
        parts = []
        for where, m in same_length(batch):
            step = max(1, max_bytes // (8 * m.shape[1]))
            for at in range(0, len(m), step):
                piece = m[at : at + step]
                parts.append((where[at : at + step], np.asarray(fn(piece), dtype=np.float64).reshape(len(piece))))
        return _numbers(len(batch), parts)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = None
        for batch in batches:
            fn = fn or kept_in_process(key, load)  # a task without rows loads nothing
            yield scored(batch, fn)

    return run(x)
