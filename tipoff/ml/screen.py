"""Cheap screening of features before a model sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.select import numeric_columns

MIN_CORRELATION = 0.01


def label_correlations(df: DataFrame, label: str) -> DataFrame:
    """(feature, r) of every numeric column with the label: one aggregation over all columns, then unpivoted."""
    target = F.col(label).cast("double")
    features = [c for c in numeric_columns(df) if c != label]
    one_row = df.agg(*[F.corr(F.col(c).cast("double"), target).alias(c) for c in features])
    return one_row.unpivot([], features, "feature", "r")


def drop_uncorrelated(df: DataFrame, label: str, train: DataFrame | None = None, least: float = MIN_CORRELATION) -> DataFrame:
    """Drop numeric columns whose correlation with the label is below ``least``, judged on the training rows."""
    found = label_correlations(df if train is None else train, label).where(F.abs("r") < least)
    weak = {row.feature for row in found.collect()}  # names only, at most one per column
    return df.select(*[c for c in df.columns if c not in weak])
