"""From probabilities to stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.scalar import predicted


def scenario_mean(scored: DataFrame, keys: list[str], probabilities: list[str]) -> DataFrame:
    """Mean probability over the line-up scenarios of a game."""
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in probabilities])


def with_classes(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``is_predicted_home_win_x`` for every ``proba_x``."""
    models = [c.removeprefix("proba_") for c in scored.columns if c.startswith("proba_")]
    return scored.select("*", *[predicted(f"proba_{m}", threshold).alias(f"is_predicted_home_win_{m}") for m in models])


def backfilled(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Open predictions (NULL label) of games that have been played since, with their label."""
    from tipoff.functions.scalar import home_win

    known = results.select("game_id", home_win("pts_home", "pts_guest").alias("__won")).where("__won is not null")
    return predictions.where(F.col("is_home_win").isNull()).join(known, "game_id").select(
        *[F.col("__won").alias(c) if c == "is_home_win" else F.col(c) for c in predictions.columns])
