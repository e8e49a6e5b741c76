"""Registry: each operator as a query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


CHECKING = True  # rounding serves the row-by-row comparison only; the bench turns it off
NUDGE = 1 + 1e-11
_WIDE = Context(prec=400)
LARGE, LARGE_DIGITS = 1000, 2


def _nearest(value: Column, scale: Column, exact: Column) -> Column:
    """``exact``, which rounds by decimal digits, taken only where ``value`` may lie on the edge between two results.

    Anywhere else the nearest whole number of the scaled value is certain (its error is below 2e-5 here), and one division gives the same double.
    """
    scaled = value * scale
    whole = F.rint(scaled)
    sure = (F.abs(scaled - whole) < 0.4999) & (F.abs(scaled) < 1e11)
    return F.when(sure, whole / scale + 0.0).otherwise(exact)  # no negative zero


def nudged() -> Callable[[np.ndarray], np.ndarray] | None:
    """``rounded`` with ``nudge`` for arrays, where a frame of many doubles is made in Arrow batches: thousands of roundings by decimal digits a
    row group cost more there than the values."""
    if not CHECKING:
        return None

    def run(values: np.ndarray) -> np.ndarray:
        value = values * NUDGE
        large = np.abs(value) >= LARGE
        digits, scale = np.where(large, LARGE_DIGITS, DIGITS), np.where(large, 10.0 ** LARGE_DIGITS, 10.0 ** DIGITS)
        scaled = value * scale
        whole = np.rint(scaled)
        out = whole / scale + 0.0
        with np.errstate(invalid="ignore"):  # infinity less itself
            sure = (np.abs(scaled - whole) < 0.4999) & (np.abs(scaled) < 1e11)
        for at in np.flatnonzero(~sure & ~np.isnan(value)).tolist():  # by its decimal digits, as Spark rounds
            exact = Decimal(repr(float(value[at])))
            if exact.is_finite():
                exact = exact.quantize(Decimal(1).scaleb(-int(digits[at])), ROUND_HALF_UP, _WIDE)
            out[at] = float(exact) + 0.0
        return out

    return run


def rounded(df: DataFrame, digits: int = DIGITS, nudge: bool | frozenset[str] = False, done: frozenset[str] = frozenset()) -> DataFrame:
    """All doubles at a fixed number of decimals, as the oracle rounds them.

    ``nudge`` is for quotients. They often end in an exact 5 one place further, so ties are moved off the
    edge on both sides, where the last bit of a double would otherwise decide; and a quotient by a value
    close to zero is large with few exact decimals, so large values keep two. It may name the quotients. ``done`` names columns that are rounded already.
    """
    if not CHECKING:
        return df

    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in done]
    few = len(doubles) <= 8  # more code for each column than this saves would leave the JIT compiler's limit

    def fixed(name):
        if nudge is False or nudge is not True and name not in nudge:
            plain = F.round(name, digits)
            return (_nearest(F.col(name), F.lit(10.0 ** digits), plain) if few else plain).alias(name)
        value = F.col(name) * NUDGE
        large = F.abs(value) >= LARGE
        scale = F.when(large, F.lit(10.0 ** LARGE_DIGITS)).otherwise(F.lit(10.0 ** digits))
        plain = F.when(large, F.round(value, LARGE_DIGITS)).otherwise(F.round(value, digits))
        return (_nearest(value, scale, plain) if few else plain).alias(name)

    return df.select(*[fixed(c) if c in doubles else F.col(c) for c in df.columns])


def sql_round(expression: str, alias: str, digits: int = DIGITS, nudge: bool = False) -> str:
    if not nudge:
        return f"round({expression}, {digits}) as {alias}"
    value = f"({expression}) * (1 + 1e-11)"
    return f"case when abs({value}) >= {LARGE} then round({value}, {LARGE_DIGITS}) else round({value}, {digits}) end as {alias}"
