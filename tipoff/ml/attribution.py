"""How much each feature moved each prediction."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]


def importance_table(attributions: DataFrame, features: list[str], top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    one_row = attributions.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in features])
    table = one_row.unpivot([], features, "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")
    return table.limit(top) if top else table


def linear_attribution(df: DataFrame, features: list[str], coefficients: list[float], keep: list[str]) -> DataFrame:
    """Exact attributions of a linear score: coefficient times distance from the mean."""
    means = F.broadcast(df.agg(*[F.avg(c).alias(f"__m_{c}") for c in features]))  # one row
    return df.join(means).select(*keep, *[
        ((F.col(c) - F.col(f"__m_{c}")) * float(b)).alias(c) for c, b in zip(features, coefficients)])


def sampled_attribution(df: DataFrame, background: dict[str, float], score: Scorer, features: list[str], keep: list[str],
                        permutations: int = 2, seed: int = 42) -> DataFrame:
    """Shapley values estimated over sampled feature orders (Strumbelj and Kononenko).

    Every row is scored along each order, switching one feature after the other from the background to the
    row's own value; a feature's attribution is the mean change it causes. Each order is followed forwards
    and backwards. The attributions of a row sum to its score minus the background's score.

    The walk is one explode of ``2 * permutations * (features + 1)`` scored copies per row, and one aggregation.
    ``score`` adds a ``proba`` column to rows that have the feature columns.
    """
    rng = random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = features[:]
        rng.shuffle(order)
        orders += [order, order[::-1]]
    place = {c: F.element_at(F.array(*[F.lit(o.index(c)) for o in orders]), F.col("__order") + 1) for c in features}
    walked = df.select(
        *keep, *features, F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("__order")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("__step"))
    mixed = walked.select(*keep, "__order", "__step", *[
        F.when(place[c] < F.col("__step"), F.col(c)).otherwise(F.lit(float(background[c]))).alias(c) for c in features])
    scored = score(mixed)
    n = float(len(orders))
    # a feature adds the score after its step and takes off the score before it
    sums = [(F.sum(F.when(F.col("__step") == place[c] + 1, F.col("proba"))
                   .when(F.col("__step") == place[c], -F.col("proba")).otherwise(F.lit(0.0))) / n).alias(c) for c in features]
    return scored.groupBy(*keep).agg(*sums)


def combined(parts: dict[str, DataFrame], weights: dict[str, float], features: list[str], keep: list[str]) -> DataFrame:
    """Attributions of a weighted ensemble: the weighted mean of its models' attributions."""
    total = sum(weights[m] for m in parts)
    rows = None
    for model, df in parts.items():
        scaled = df.select(*keep, *[(F.col(c) * (weights[model] / total)).alias(c) for c in features])
        rows = scaled if rows is None else rows.unionByName(scaled)
    return rows.groupBy(*keep).agg(*[F.sum(c).alias(c) for c in features])


def win_probability(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn("proba", vector_to_array(F.col(column))[1])
