"""Backward feature elimination driven by cross-validated importance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.ml.learners import fold_pair, model_for, win_proba
from tipoff.ml.metrics import is_better, score


def fold_importances(folded: DataFrame, families: list[str], features: list[str], folds: int, metric: str
                     ) -> tuple[list[tuple[str, int, str, float]], list[float]]:
    """Long rows (family, fold, feature, importance) and the score of the averaged models per fold.

    Non-finite importances count as 0 and each model's importances are scaled to sum to 1.
    """
    rows, scores = [], []
    for fold in range(folds):
        train, test = fold_pair(folded, fold, expanding=True)
        scored, columns = test, []
        for family in families:
            model = model_for(family, features).fit(train)
            # a feature owns its filled value and its missing flag
            raw = [v if math.isfinite(v) else 0.0 for v in model.stages[-1].featureImportances.toArray().tolist()]
            own = [raw[i] + raw[i + len(features)] for i in range(len(features))]
            total = sum(own)
            rows += [(family, fold, f, v / total if total > 1e-10 else 0.0) for f, v in zip(features, own)]
            keep = [c for c in scored.columns]
            scored = win_proba(model.transform(scored), f"proba_{family}").select(*keep, f"proba_{family}")
            columns.append(f"proba_{family}")
        mean = sum(F.col(c) for c in columns) / len(columns)
        scores.append(score(scored.withColumn("proba", mean), "is_home_win", "proba", metric))
    return rows, scores


def mean_importance(spark: SparkSession, rows: list[tuple[str, int, str, float]]) -> DataFrame:
    """Importance averaged over models, then over folds."""
    long = spark.createDataFrame(rows, "family string, fold int, feature string, importance double")
    per_fold = long.groupBy("fold", "feature").agg(F.avg("importance").alias("importance"))
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))


def eliminate(folded: DataFrame, features: list[str], families: list[str] = ("forest",), folds: int = 3,
              metric: str = "accuracy", max_features: int | None = None, drop_share: float = 0.1
              ) -> tuple[list[str], DataFrame]:
    """Drop the least important tenth (at least one) per step down to one feature; keep the best-scoring set.

    Returns the chosen features and the history: step, number of features, mean and spread of the score.
    """
    spark = folded.sparkSession
    current, history = list(features), []
    best, best_score, step = list(features), None, 0
    while True:
        step += 1
        rows, scores = fold_importances(folded, list(families), current, folds, metric)
        mean = sum(scores) / len(scores)
        spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
        history.append((step, len(current), current[:], mean, spread))
        if (max_features is None or len(current) <= max_features) and is_better(metric, mean, best_score):
            best, best_score = current[:], mean
        if len(current) == 1:
            break
        n = min(max(1, int(len(current) * drop_share)), len(current) - 1)
        weakest = mean_importance(spark, rows).orderBy("importance", "feature").limit(n)
        dropped = {r.feature for r in weakest.collect()}  # names only
        current = [f for f in current if f not in dropped]
    table = spark.createDataFrame(
        history, "step int, n_features int, features array<string>, mean_score double, std_score double")
    return best, table


__all__ = ["eliminate", "fold_importances", "mean_importance"]
