"""Vectorised per-block arithmetic for the wide feature blocks.

Spark orders, cuts and shuffles the rows into bounded blocks; inside a block these helpers turn a
(rows x stats) matrix into hundreds of columns at once. The same maths as JVM windows over 350 columns
spends nearly all of its time on generated code and row copies (see README, "Measured choices").
NaN stands for NULL here and becomes NULL again on the way out.
"""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Types whose values a long holds exactly.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


class Packed:
    """Rows on their way into Arrow batches: all whole numbers in one array column, all doubles in another, the rest as they are.

    Spark's Arrow writer asks every column for its size in bytes before each row, which takes several times as long as writing the values. Two
    columns in place of many are asked less often. ``unpack`` gives batches of the rows' own columns again.

    The doubles ``small`` go through the shuffle before that in two array columns as well (``shrink``): whole numbers of two bytes, which stats of a game
    mostly are, and what is no such number. Every value comes back, but NULL as NaN and a negative zero as zero.
    """

    MISSING, ELSEWHERE = -32767, -32768

    def __init__(self, df: DataFrame, small: list[str] | None = None):
        self.schema, self.small = to_arrow_schema(df.schema), small or []
        kinds: dict[str, list[str]] = {"__wholes": [], "__doubles": []}
        self.plain = []
        for field in df.schema.fields:
            if field.name in self.small:
                continue
            fraction = isinstance(field.dataType, T.DoubleType) and not self.small
            kind = "__wholes" if isinstance(field.dataType, _WHOLE) else "__doubles" if fraction else None
            (kinds[kind] if kind else self.plain).append(field.name)
        self.arrays = {kind: names for kind, names in kinds.items() if names}

    def shrink(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__small`` and ``__exact`` in place of the doubles ``small``."""
        if not self.small:
            return df

        def short(value: Column | int) -> Column:
            return (value if isinstance(value, Column) else F.lit(value)).cast("smallint")

        def whole(name: str) -> Column:
            return F.col(name).try_cast("smallint")

        def fits(name: str) -> Column:
            return F.coalesce((whole(name).cast("double") == F.col(name)) & (whole(name) > self.MISSING), F.lit(False))

        numbers = [F.when(fits(n), whole(n)).when(F.col(n).isNull(), short(self.MISSING)).otherwise(short(self.ELSEWHERE)) for n in self.small]
        others = F.array_compact(F.array(*[F.when(~fits(n), F.col(n)) for n in self.small]))
        none = F.array().cast("array<double>")  # most rows: nothing to gather
        others = F.when(reduce(or_, [~fits(n) for n in self.small]), others).otherwise(none)
        return df.select(*[c for c in df.columns if c not in self.small], F.array(*numbers).alias("__small"), others.alias("__exact"))

    def pack(self, df: DataFrame) -> DataFrame:
        """The columns for Python, of rows that ``shrink`` returned."""
        def whole(name: str) -> Column:
            return (F.unix_date(name) if pa.types.is_date(self.schema.field(name).type) else F.col(name)).cast("long")

        if self.small:
            numbers = [F.get("__small", F.lit(j)).cast("long") for j in range(len(self.small))]
            return df.select(*self.plain, F.array(*map(whole, self.arrays.get("__wholes", [])), *numbers).alias("__wholes"),
                             F.col("__exact").alias("__doubles"))
        return df.select(*self.plain, *[F.array(*[whole(n) if kind == "__wholes" else F.col(n) for n in names]).alias(kind)
                                        for kind, names in self.arrays.items()])

    def unpack(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {name: batch.column(name) for name in self.plain}
        for kind, names in self.arrays.items():
            values = batch.column(kind).flatten()
            for j, name in enumerate(names):
                column, wanted = values.take(pa.array(np.arange(j, len(values), len(names) + len(self.small)))), self.schema.field(name).type
                columns[name] = (column.cast(pa.int32()) if pa.types.is_date(wanted) else column).cast(wanted)
        if self.small:
            n = len(self.arrays.get("__wholes", []))
            numbers = batch.column("__wholes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n + len(self.small))[:, n:]
            values = np.where(numbers == self.MISSING, np.nan, numbers)
            values[numbers == self.ELSEWHERE] = batch.column("__doubles").flatten().to_numpy(zero_copy_only=False)  # row by row, as they were gathered
            columns.update((name, pa.array(column)) for name, column in zip(self.small, np.ascontiguousarray(values.T)))
        return pa.RecordBatch.from_arrays([columns[n] for n in self.schema.names], schema=self.schema)


def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns])


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        other = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))), False)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        change[1:] |= other.to_numpy(zero_copy_only=False) | (known[1:] != known[:-1])  # NULL is a key like others
    return np.flatnonzero(change)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str],
             compute: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand ``compute`` whole groups of a stream sorted by ``keys``, many small groups at a time.

    Only the group that a batch leaves unfinished is kept for the next one.
    """
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*pending, batch])
        first = starts(table, keys)
        cut = int(first[-1]) if len(first) else 0
        if cut:
            yield compute(table.slice(0, cut), first[:-1])
        pending = table.slice(cut).to_batches()
    if pending:
        table = pa.Table.from_batches(pending)
        if table.num_rows:
            yield compute(table, starts(table, keys))


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    """Rows of each of the groups that begin at the rows ``first`` of ``n``."""
    return np.diff(np.append(first, n))


def before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums of each group by itself: entry i sums the group's rows before i."""
    out = np.zeros(values.shape)
    for a, b in zip(first.tolist(), np.append(first[1:], len(values)).tolist()):
        if b - a > 1:
            np.cumsum(values[a:b - 1], axis=0, out=out[a + 1:b])
    return out


def lag(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape)
    out[1:] = values[:-1]
    out[first] = np.nan
    return out


def divide(top, bottom) -> np.ndarray:
    """Quotient with NaN where the divisor is zero or missing."""
    bottom = np.asarray(bottom, dtype=np.float64)
    out = np.full(np.broadcast(top, bottom).shape, np.nan)
    return np.divide(top, bottom, out=out, where=bottom != 0)


class Sums:
    """Counts, sums and squares of a matrix's groups of rows (which begin at ``first``), ready for any window length."""

    def __init__(self, values: np.ndarray, first: np.ndarray, include_current: bool = False, spread: bool = True):
        n, k = values.shape
        known = ~np.isnan(values)
        size = lengths(first, n)
        self.at, self.start = np.arange(n), np.repeat(first, size)
        # deviations from a group's first known value keep the spread of a constant series at exactly zero
        self.origin = np.zeros((n, k))
        if n:
            place = np.minimum.reduceat(np.where(known, self.at[:, None], n), first, axis=0)
            origin = np.where(place < n, values[np.minimum(place, n - 1), np.arange(k)], 0.0)
            self.origin = np.repeat(origin, size, axis=0)
        dev = np.where(known, values - self.origin, 0.0)
        own = np.concatenate([known, dev, dev * dev] if spread else [known, dev], axis=1)
        self.k, self.ahead = k, 1 if include_current else 0
        self.running = before(own, first)
        self.through = self.running + own if include_current else self.running

    def _over(self, window: int, parts: int) -> list[np.ndarray]:
        low = np.maximum(self.at + self.ahead - window, self.start)
        both = self.through[:, :parts * self.k] - self.running[low, :parts * self.k]
        return [both[:, i * self.k:(i + 1) * self.k] for i in range(parts)]

    def window(self, window: int, least: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(mean, total) over ``window`` rows; NaN below ``least`` values."""
        c, s = self._over(window, 2)
        enough = c >= np.maximum(least, 1)
        # divide the plain total, so that whole numbers give the same mean in any order of rows
        total = s + self.origin * c
        return np.where(enough, divide(total, c), np.nan), np.where(enough, total, np.nan)

    def deviation(self, window: int, least: int) -> np.ndarray:
        """Sample standard deviation over ``window`` rows; NaN below ``least`` values."""
        c, s, q = self._over(window, 3)
        var = np.maximum(divide(q - divide(s * s, c), c - 1), 0.0)
        return np.where((c >= max(least, 1)) & (c > 1), np.sqrt(var), np.nan)

    def seen(self) -> np.ndarray:
        return self.through[:, :self.k]


def weighted_mean(values: np.ndarray, first: np.ndarray, age: np.ndarray, keep: float, halo: int) -> np.ndarray:
    """Exponentially weighted mean of a group's rows before each row; ``age`` counts from the block's first row."""
    weight = np.where(age >= -halo, np.exp(np.maximum(age, -halo) * -math.log(keep)), 0.0)[:, None]
    known, k = ~np.isnan(values), values.shape[1]
    sums = before(np.concatenate([np.where(known, values * weight, 0.0), np.where(known, weight, 0.0)], axis=1), first)
    return divide(sums[:, :k], sums[:, k:])


def doubles(values: np.ndarray) -> list[pa.Array]:
    """Arrow columns from the rows of a (columns x rows) array, cut from one conversion."""
    n = values.shape[1]
    whole = pa.array(np.ascontiguousarray(values).ravel(), type=pa.float64(), from_pandas=True)
    return [whole.slice(i * n, n) for i in range(len(values))]
