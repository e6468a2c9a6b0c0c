"""Runs of equal keys in sorted Arrow batches as numpy arrays, for functions that solve one block or component at a time.
A run costs a few slices, so that tables of very many small groups aren't held up by it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Rows that a batch of results has at least, but for the last.
LEAST_OUT = 1 << 14


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of a batch; arrays of numbers become a matrix of doubles, a row each, and so do packed vectors."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths != lengths[0]).any():
                raise ValueError(f"vectors of different lengths in {name}")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.astype(np.float64, copy=False).reshape(len(column), -1)
        elif pa.types.is_binary(column.type):
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if (np.diff(ends) != ends[1] - ends[0]).any():
                raise ValueError(f"vectors of different lengths in {name}")
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            out[name] = flat.view(np.float64).reshape(len(column), (ends[1] - ends[0]) // 8)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


@F.arrow_udf(BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """Arrays of numbers as the bytes of their doubles, which rows are copied, shuffled and sorted with in one piece and not
    number by number."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
    flat = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal ``key``, across batch borders."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([part[c] for part in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = columns_of(batch)
        new = np.zeros(batch.num_rows - 1, bool)
        for c in key:
            new |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if held and any(held[-1][c][0] != columns[c][x] for c in key):
                yield whole()
                held = []
            held.append({c: values[x:y] for c, values in columns.items()})
    if held:
        yield whole()


def in_batches(parts: Iterable[tuple[np.ndarray, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of ``schema`` from the columns of many small parts."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def batch() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for part in parts:
        if len(part[0]):
            held.append(part)
            rows += len(part[0])
        if rows >= LEAST_OUT:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()
