"""Small helpers shared by the operators: columns of Arrow batches, checked broadcasts, streamed output."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of at most this many bytes together are sent to every executor; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, bytes_per_row: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when its counted rows stay under ``BROADCAST_BYTES``; else unchanged."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def raw_texts(column: pa.ChunkedArray | pa.Array, rows: int = 128) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes, without decoding; ``rows`` of them at a time are held beside the batch."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(kind).to_pylist()


def tidied(run: Callable) -> Callable:
    """A function over a task's batches that gives freed memory back to the system at its end: the worker lives on, beside others."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own ways
                pass

    return wrapped


def in_batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches, cut by rows and by the bytes of their binary and text values."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])
