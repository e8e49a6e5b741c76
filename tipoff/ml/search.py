"""Parameter search whose trials are kept in a ledger: it can be stopped at any time and goes on where it was."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.ml.learners import FAMILIES, SEED, draw, fit_predict, fold_pair, model_for
from tipoff.ml.metrics import is_better, score


class Ledger:
    """Append-only scores of (trial, fold), one folder each, so that writers do not meet and an entry written twice is one entry.

    ``path`` lies where the whole cluster can reach it. A search is known by its family, metric and seed.
    """

    COLUMNS = "family string, metric string, seed bigint, trial int, fold int, params string, score double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self.COLUMNS).write.mode("overwrite").json(f"{self.path}/opened")

    def add(self, family: str, metric: str, seed: int, trial: int, fold: int, params: dict, value: float) -> None:
        row = [(family, metric, seed, trial, fold, json.dumps(params, sort_keys=True), float(value))]
        entry = f"{self.path}/{family}-{metric}-{seed}-{trial}-{fold}"
        self.spark.createDataFrame(row, self.COLUMNS).coalesce(1).write.mode("overwrite").json(entry)

    def trials(self) -> DataFrame:
        return self.spark.read.schema(self.COLUMNS).json(f"{self.path}/*")

    def scores(self, family: str, metric: str, seed: int) -> dict[tuple[int, int], float]:
        """What is known of a search: trials times folds numbers."""
        rows = self.trials().where((F.col("family") == family) & (F.col("metric") == metric) & (F.col("seed") == seed))
        return {(r.trial, r.fold): r.score for r in rows.select("trial", "fold", "score").collect()}


@dataclass
class Tuned:
    """The best trial, and the model of its parameters fitted on all rows."""

    trial: int
    params: dict
    score: float
    model: PipelineModel


def drawn(family: str, trials: int, seed: int = SEED, space: dict | None = None) -> list[dict]:
    """Parameters of each trial, the family's own first. More trials leave earlier ones as they are."""
    rng = random.Random(seed)
    return [{}] + [draw(space or FAMILIES[family].space, rng) for _ in range(trials - 1)]


def survivors(scores: dict[tuple[int, int], float], alive: list[int], fold: int, metric: str, keep: float) -> list[int]:
    """The better ``keep`` of the trials by their mean so far, at least one; of equal ones the first."""
    left, out = list(alive), []
    means = {t: sum(scores[t, f] for f in range(fold + 1)) / (fold + 1) for t in alive}
    while left and len(out) < max(1, round(len(alive) * keep)):
        best = left[0]
        for t in left[1:]:
            if is_better(metric, means[t], means[best]):
                best = t
        out.append(best)
        left.remove(best)
    return sorted(out)


def tune(folded: DataFrame, family: str, features: list[str], ledger: Ledger, metric: str = "roc_auc", trials: int = 100, folds: int = 3,
         expanding: bool = True, seed: int = SEED, keep: float = 0.5, weight: str | None = None, threads: int = 4,
         space: dict | None = None) -> Tuned:
    """Random search, one fold after the other: all trials that are left are scored on a fold, the better ``keep`` of them go on.

    Folds that the ledger has are not fitted again, and what goes on depends on scores only, so a search that was stopped ends with the same ledger
    as one that was not; with more ``trials`` it goes on from the trials it has. Fits are Spark jobs from a bounded pool of driver threads.
    """
    params, alive = drawn(family, trials, seed, space), list(range(trials))
    scores = ledger.scores(family, metric, seed)
    for fold in range(folds):
        train, test = fold_pair(folded, fold, expanding)

        def run(trial: int, fold: int = fold, train: DataFrame = train, test: DataFrame = test) -> None:
            scored = fit_predict(train, test, family, features, ["is_home_win"], params[trial], weight=weight)
            value = float(score(scored, "is_home_win", "proba", metric))
            ledger.add(family, metric, seed, trial, fold, params[trial], value)
            scores[trial, fold] = value

        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(run, [t for t in alive if (t, fold) not in scores]))
        if fold + 1 < folds:
            alive = survivors(scores, alive, fold, metric, keep)
    best = survivors(scores, alive, folds - 1, metric, 0.0)[0]
    model = model_for(family, features, params[best], weight).fit(folded)
    return Tuned(best, params[best], sum(scores[best, f] for f in range(folds)) / folds, model)
