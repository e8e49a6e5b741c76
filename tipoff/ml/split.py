"""Time-ordered splits, folds and sample weights. Positions come from ``ordered.numbered``: no task sorts the whole
table, nor all the games of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.operators.ordered import ORDINAL, TOTAL, numbered

HELPERS = (ORDINAL, TOTAL)


def _placed(df: DataFrame) -> DataFrame:
    """0-based place in (date, game_id) order and the number of rows."""
    return numbered(df, ("date", "game_id"))


def train_test(df: DataFrame, cutoff: str, train_size: float = 0.85) -> DataFrame:
    """Rows before ``cutoff``; the first ``round(n * train_size)`` in time order get role train, the rest test.

    Half a row rounds to the even side.
    """
    rows = _placed(df.where(F.col("date") < F.lit(cutoff).cast("date")))
    size = F.bround(F.col(TOTAL) * F.lit(train_size), 0)
    return rows.select(*df.columns, F.when(F.col(ORDINAL) < size, "train").otherwise("test").alias("role"))


def hold_out(df: DataFrame, fraction: float, roles: tuple[str, str] = ("tune", "meta")) -> DataFrame:
    """The last ``fraction`` of the rows in time order get the second role."""
    rows = _placed(df)
    cut = F.floor(F.col(TOTAL) * F.lit(1 - fraction))
    return rows.select(*df.columns, F.when(F.col(ORDINAL) < cut, roles[0]).otherwise(roles[1]).alias("role"))


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """One row per (row, fold) with role train or test: tests are equal blocks at the end, training is all before."""
    rows = _placed(df)
    block = F.floor(F.col(TOTAL) / (folds + 1))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    spread = rows.select("*", block.alias("__block"), fold.alias("fold"))
    start = F.col(TOTAL) - (folds - F.col("fold")) * F.col("__block")
    role = F.when(F.col(ORDINAL) < start, "train").when(F.col(ORDINAL) < start + F.col("__block"), "test")
    return spread.select(*df.columns, F.col("fold").cast("bigint").alias("fold"), role.alias("role")).where("role is not null")


def test_fold(df: DataFrame, folds: int = 5) -> DataFrame:
    """The fold in which each row is tested under ``expanding_folds``; NULL for the first block, and for all rows if they are too few."""
    rows = _placed(df)
    block = F.floor(F.col(TOTAL) / (folds + 1))
    fold = folds - 1 - F.floor(F.try_divide(F.col(TOTAL) - 1 - F.col(ORDINAL), block))
    return rows.select(*df.columns, F.when(fold >= 0, fold).cast("bigint").alias("fold"))


# Multiplicative hashing (Knuth): fixed values
_HASH_FACTOR, _HASH_RANGE = 2654435761, 2**32


def shuffle_key(df: DataFrame, key: str, seed: int = 0) -> Column:
    """Reproducible pseudo-random number below 2**32 of a whole number, or of any other key by way of its hash.

    The product is taken in two halves of the factor, so that no key overflows.
    """
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    small = F.pmod(F.pmod(F.col(key).cast("bigint") if whole else F.xxhash64(key), F.lit(_HASH_RANGE)) + seed, F.lit(_HASH_RANGE))
    high, low = divmod(_HASH_FACTOR, 2**16)
    return (((small * high) % 2**16) * 2**16 + small * low) % F.lit(_HASH_RANGE)


def stratified_folds(df: DataFrame, label: str, key: str = "game_id", folds: int = 5, seed: int = 0) -> DataFrame:
    """Shuffled folds with the same share of each label: place within the label in hash order, modulo folds."""
    rows = numbered(df.withColumn("__h", shuffle_key(df, key, seed)), ("__h", key), by=(label,))
    return rows.select(*df.columns, (F.col(ORDINAL) % folds).alias("fold"))


def recency_weights(df: DataFrame, decay: float = 0.99, by: str = "date") -> DataFrame:
    """Weight ``decay ** days before the newest row`` (or rows, with ``by="row"``), scaled to sum to the row count."""
    if by == "row":
        rows, age = _placed(df), F.col(TOTAL) - F.col(ORDINAL) - 1
    else:
        newest = df.agg(F.max("date").alias("__newest"))
        rows, age = df.join(F.broadcast(newest)), F.datediff("__newest", "date")  # one row
    raw = rows.select(*df.columns, F.pow(F.lit(decay), age).alias("__w"))
    scale = raw.agg((F.count(F.lit(1)) / F.sum("__w")).alias("__scale"))
    return raw.join(F.broadcast(scale)).select(  # one row
        *df.columns, (F.col("__w") * F.col("__scale")).alias("sample_weight"))
