"""A search that is stopped goes on from its ledger and ends as one that was not stopped."""

import random

import pytest
from pyspark.sql import functions as F

from tipoff.ml import search
from tipoff.ml.learners import fit_predict, prepared, win_proba
from tipoff.ml.search import Ledger, drawn, survivors, tune
from tipoff.session import new_path

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(5)
    rows = []
    for k in range(240):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((k, rng.random() < 1 / (1 + 2.7 ** -a), a, None if k % 17 == 0 else b, k // 80 - 1 if k >= 80 else None, 0.5 + k / 240))
    df = spark.createDataFrame(rows, "game_id long, is_home_win boolean, a double, b double, fold long, w double")
    return prepared(df, FEATURES).cache()


def _entries(ledger):
    return sorted((r.trial, r.fold, r.params, round(r.score, 9)) for r in ledger.trials().collect())


def _tune(folded, ledger, trials=4):
    return tune(folded, "logistic", FEATURES, ledger, "log_loss", trials=trials, folds=2, weight="w", threads=2)


def test_stopped_and_resumed(spark, folded, monkeypatch):
    whole = Ledger(spark, new_path(spark, "whole"))
    best = _tune(folded, whole)
    entries = _entries(whole)
    assert [e[:2] for e in entries if e[1] == 0] == [(t, 0) for t in range(4)] and len(entries) == 6  # half goes on

    path, fits = new_path(spark, "stopped"), []

    def failing(*args, **named):
        if len(fits) == 3:
            raise RuntimeError("killed")
        fits.append(1)
        return fit_predict(*args, **named)

    monkeypatch.setattr(search, "fit_predict", failing)
    with pytest.raises(RuntimeError):
        _tune(folded, Ledger(spark, path))
    kept = _entries(Ledger(spark, path))
    assert kept and set(kept) < set(entries)

    fits.clear()
    monkeypatch.setattr(search, "fit_predict", lambda *a, **n: fits.append(1) or fit_predict(*a, **n))
    resumed = Ledger(spark, path)
    again = _tune(folded, resumed)
    assert _entries(resumed) == entries and len(fits) == len(entries) - len(kept)
    assert (again.trial, again.params) == (best.trial, best.params) and abs(again.score - best.score) < 1e-9

    fits.clear()
    _tune(folded, resumed, trials=5)  # one trial more, and whoever it lets go on
    assert set(entries) <= set(_entries(resumed)) and 1 <= len(fits) <= 3


def test_best_is_fitted_on_all_rows(spark, folded):
    best = _tune(folded, Ledger(spark, new_path(spark, "refit")))
    mine = {r.game_id: r.proba for r in win_proba(best.model.transform(folded)).collect()}
    direct = fit_predict(folded, folded, "logistic", FEATURES, ["game_id"], best.params, weight="w").collect()
    assert all(abs(mine[r.game_id] - r.proba) < 1e-9 for r in direct) and len(mine) == 240


def test_weights_reach_the_learner(spark, folded):
    light = folded.withColumn("w", F.when(F.col("is_home_win"), 1e-6).otherwise(1.0))
    scored = fit_predict(light, folded, "logistic", FEATURES, ["game_id"], weight="w")
    assert scored.agg(F.max("proba")).first()[0] < 0.05


def test_survivors():
    scores = {(0, 0): 0.5, (1, 0): 0.7, (2, 0): 0.7, (3, 0): 0.9}
    assert survivors(scores, [0, 1, 2, 3], 0, "roc_auc", 0.5) == [1, 3]
    assert survivors(scores, [0, 1, 2, 3], 0, "log_loss", 0.5) == [0, 1]
    assert survivors(scores, [0, 1, 2, 3], 0, "log_loss", 0.0) == [0]
    assert drawn("logistic", 3) == drawn("logistic", 9)[:3]
