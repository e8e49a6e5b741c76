"""Evaluation of win probabilities as aggregations: one pass per table, whatever the number of metrics.

Rows without a label or without a probability are left out. ``model`` (or any grouping key) may be given to evaluate many at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalar import ratio
from tipoff.operators.ordered import UNBOUNDED, cumulative

TINY = 2.220446049250313e-16  # probabilities are kept this far from 0 and 1 in the log loss


@dataclass(frozen=True)
class Metric:
    """An aggregate over (label, probability); ``needs_proba`` tells whether the threshold is ignored."""

    build: Callable[[Column, Column, float], Column]
    maximise: bool = True
    needs_proba: bool = False


def _counts(y: Column, p: Column, t: float) -> dict[str, Column]:
    hit = p >= t
    return {"tp": F.count_if(hit & y), "fp": F.count_if(hit & ~y), "fn": F.count_if(~hit & y), "tn": F.count_if(~hit & ~y)}


def share(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 when nothing was counted."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(ratio(top, bottom))


def scores(c: dict[str, Column], beta: float = 1.0) -> dict[str, Column]:
    """All threshold metrics from the four confusion counts."""
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    b2 = beta * beta
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "fbeta": F.try_divide((1 + b2) * precision * recall, b2 * precision + recall),
        "balanced_accuracy": (sensitivity + specificity) / 2, "youden": sensitivity + specificity - 1,
    }


def log_loss(y: Column, p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))
    return F.avg(-F.log(F.when(y, safe).otherwise(1 - safe)))


def _threshold_metric(name: str) -> Metric:
    return Metric(lambda y, p, t: scores(_counts(y, p, t))[name])


def _weighted_f1(y: Column, p: Column, t: float) -> Column:
    c = _counts(y, p, t)
    mirror = {"tp": c["tn"], "fp": c["fn"], "fn": c["fp"], "tn": c["tp"]}
    pos, neg = c["tp"] + c["fn"], c["tn"] + c["fp"]
    return ratio(scores(c)["f1"] * pos + scores(mirror)["f1"] * neg, pos + neg)


METRICS: dict[str, Metric] = {
    **{n: _threshold_metric(n) for n in ("accuracy", "precision", "recall", "f1", "balanced_accuracy")},
    "f1_weighted": Metric(_weighted_f1),
    "log_loss": Metric(lambda y, p, t: log_loss(y, p), maximise=False, needs_proba=True),
    "neg_log_loss": Metric(lambda y, p, t: -log_loss(y, p), needs_proba=True),
    "brier_score": Metric(lambda y, p, t: F.avg((p - y.cast("double")) ** 2), maximise=False, needs_proba=True),
    "neg_brier_score": Metric(lambda y, p, t: -F.avg((p - y.cast("double")) ** 2), needs_proba=True),
}
RANKED = {"roc_auc", "average_precision"}  # need the order of the probabilities, not one aggregate


def is_better(metric: str, new: float, old: float | None) -> bool:
    if old is None:
        return True
    return new < old if metric in METRICS and not METRICS[metric].maximise else new > old


def evaluate(df: DataFrame, label: str, proba: str, names: list[str], threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Named metrics per group in one aggregation."""
    known = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    y, p = F.col(label), F.col(proba)
    return known.groupBy(*by).agg(*[METRICS[n].build(y, p, threshold).alias(n) for n in names])


def confusion(df: DataFrame, label: str, proba: str, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    known = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    return known.groupBy(*by).agg(*[e.alias(n) for n, e in _counts(F.col(label), F.col(proba), threshold).items()])


def class_report(df: DataFrame, label: str, proba: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    c = confusion(df, label, proba, threshold)
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("outcome"), F.col("tp").alias("tp"), F.col("fp").alias("fp"), F.col("fn").alias("fn"), F.col("tn").alias("tn")),
        F.struct(F.lit(False).alias("outcome"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"), F.col("tp").alias("tn"))))
    rows = c.select(sides.alias("s")).select("s.*")
    s = scores({k: F.col(k) for k in ("tp", "fp", "fn", "tn")})
    return rows.select("outcome", *[s[n].alias(n) for n in ("precision", "recall", "f1")],
                       (F.col("tp") + F.col("fn")).alias("support"))


# ---------------------------------------------------------------------------
# Rank metrics: exact, without sorting the table in one task
# ---------------------------------------------------------------------------

def _by_probability(df: DataFrame, label: str, proba: str, by: list[str]) -> DataFrame:
    """Counts per distinct probability with the counts below it; ties collapse before anything is ordered."""
    counted = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull()).groupBy(*by, F.col(proba).alias("__p")).agg(
        F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    return cumulative(counted, ("__p",), sums={"pos_below": F.col("pos"), "neg_below": F.col("neg")},
                      totals={"pos_all": F.col("pos"), "neg_all": F.col("neg")}, by=tuple(by))


def roc_auc(df: DataFrame, label: str, proba: str, by: list[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the share of (win, loss) pairs in the right order, ties counting half."""
    rows = _by_probability(df, label, proba, list(by))
    right = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.max(F.col("pos_all") * F.col("neg_all").cast("double"))
    return rows.groupBy(*by).agg(ratio(right, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, proba: str, by: list[str] = ()) -> DataFrame:
    rows = _by_probability(df, label, proba, list(by))
    above = (F.col("pos_all") - F.col("pos_below")).cast("double")
    all_above = above + F.col("neg_all") - F.col("neg_below")
    gain = F.sum(ratio(above, all_above) * F.col("pos"))
    return rows.groupBy(*by).agg(ratio(gain, F.max("pos_all")).alias("average_precision"))


def score(df: DataFrame, label: str, proba: str, metric: str, threshold: float = 0.5) -> float:
    """One metric as a number (one row comes back)."""
    if metric in RANKED:
        row = (roc_auc if metric == "roc_auc" else average_precision)(df, label, proba)
    else:
        row = evaluate(df, label, proba, [metric], threshold)
    value = row.first()[metric]
    if value is None:  # an undefined score is the worst there is
        worst = 0.0 if metric in RANKED or not METRICS[metric].needs_proba else float("-inf")
        return worst if metric in RANKED or METRICS[metric].maximise else float("inf")
    return float(value)


# ---------------------------------------------------------------------------
# Thresholds and model comparison
# ---------------------------------------------------------------------------

THRESHOLDS = 99
SEARCHABLE = ("f1", "accuracy", "precision", "recall", "balanced_accuracy", "youden", "fbeta")


def threshold_scores(df: DataFrame, label: str, proba: str, beta: float = 1.0) -> DataFrame:
    """All threshold metrics at 0.01, 0.02, ... 0.99.

    Rows are first counted by the number of thresholds they reach (101 groups); the thresholds are then
    running sums over those groups, so the table is read once and never multiplied.
    """
    known = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    p = F.col(proba)
    near = F.floor(p * 100)
    reached = near + F.when(p >= (near + 1) / 100, 1).when(p < near / 100, -1).otherwise(0)
    level = F.least(F.greatest(reached, F.lit(0)), F.lit(THRESHOLDS))
    counted = known.groupBy(level.cast("bigint").alias("k")).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    every = df.sparkSession.range(0, THRESHOLDS + 1).select(F.col("id").alias("k"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    levels = counted.unionByName(every).groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    up = Window.orderBy(F.col("k").desc()).rowsBetween(UNBOUNDED, 0)  # 100 rows
    whole = Window.partitionBy()
    counts = levels.select(
        "k", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(up)).alias("fn"),
        (F.sum("neg").over(whole) - F.sum("neg").over(up)).alias("tn")).where("k > 0")
    s = scores({k: F.col(k) for k in ("tp", "fp", "fn", "tn")}, beta)
    return counts.select((F.col("k") / 100).alias("threshold"), "tp", "fp", "fn", "tn", *[e.alias(n) for n, e in s.items()])


def best_threshold(df: DataFrame, label: str, proba: str, metric: str = "f1", beta: float = 1.0) -> DataFrame:
    """The best threshold and its score; the lowest wins ties. Metrics that ignore the threshold are refused."""
    if metric not in SEARCHABLE:
        raise ValueError(f"{metric} does not depend on a threshold; choose from {SEARCHABLE}")
    table = threshold_scores(df, label, proba, beta).where(F.col(metric).isNotNull())
    return table.agg(
        F.lit(metric).alias("metric"), F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"),
        F.max(metric).alias("score"))


def compare_models(df: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """AUC and threshold metrics of every ``proba_x`` column, best AUC first."""
    models = [c for c in df.columns if c.startswith("proba_")]
    long = df.unpivot([label], models, "model", "proba").withColumn("model", F.regexp_replace("model", "^proba_", ""))
    names = ["accuracy", "precision", "recall", "f1", "log_loss"]
    return evaluate(long, label, "proba", names, threshold, by=["model"]).join(
        roc_auc(long, label, "proba", by=["model"]), "model").select(
        "model", "roc_auc", *names).orderBy(F.desc("roc_auc"), "model")
