"""Model fits on a narrow feature frame, checked by rows and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.ml import attribution, combine, ensembles, learners, metrics, scoring, split
from tipoff.ml.elimination import eliminate, fold_importances, mean_importance
from tipoff.ml.search import Ledger, tune
from tipoff.ml.store import RunStore
from tipoff.operators import records, schedule
from tipoff.plans import backtest, upcoming
from tipoff.queries.base import query, rounded
from tipoff.queries.frames import coming_frame
from tipoff.session import new_path, written

FEATURES = ["win_pct_home", "win_pct_guest", "home_win_pct_home", "away_win_pct_guest", "h2h_win_pct",
            "home_days_rest", "guest_days_rest"]
CUTOFF = "2002-01-01"
_frames: dict[tuple[str, str], DataFrame] = {}


def narrow_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played games with record and rest features, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames:
        # five operators read the results: line items are summed up once for all of them
        games = written(fx.games(spark, sf_dir).where(F.col("pts_home").isNotNull()).select(*records.GAME_COLUMNS), "results")
        base = records.overall_record(games)
        drop = ["date", "season_id", "home_team", "guest_team", "is_home_win"]
        for part in (records.location_record(games), records.head_to_head(games), schedule.rest(games)):
            base = base.join(part.drop(*drop), "game_id")
        _frames[key] = written(learners.prepared(base, FEATURES).select(
            "game_id", "date", "season_id", "is_home_win", "label", *FEATURES, *[f"{c}_missing" for c in FEATURES]), "narrow")
    return _frames[key]


def parts(spark, sf_dir, size: float = 0.85):
    marked = split.train_test(narrow_frame(spark, sf_dir), CUTOFF, size)
    return marked.where("role = 'train'"), marked.where("role = 'test'")


def _fitted(spark, sf_dir, families) -> DataFrame:
    train, test = parts(spark, sf_dir)
    scored = ensembles.scored_by(train, test, families, FEATURES)
    return rounded(scored.select("game_id", "is_home_win", *[f"proba_{f}" for f in families]))


@query("m06_boosted_trees")
def m06(spark, sf_dir):
    return _fitted(spark, sf_dir, ["boosted", "boosted_leafy", "boosted_binned"])


@query("m07_bagged_trees")
def m07(spark, sf_dir):
    return _fitted(spark, sf_dir, ["forest", "extra"])


@query("m08_linear_models")
def m08(spark, sf_dir):
    return _fitted(spark, sf_dir, ["logistic", "hinge"])


@query("m09_naive_bayes")
def m09(spark, sf_dir):
    return _fitted(spark, sf_dir, ["gaussian_bayes", "bernoulli_bayes"])


@query("m10_early_stopping")
def m10(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    marked = split.hold_out(train.drop("role"), 0.2, ("fit", "stop")).withColumn("stop", F.col("role") == "stop")
    model = learners.model_for("boosted", FEATURES, {"maxIter": 40, "validationTol": 0.001}, validation="stop").fit(marked)
    scored = learners.predict(model, test, ["game_id", "is_home_win"])
    return rounded(scored.withColumn("trees", F.lit(model.stages[-1].getNumTrees)))


def _folded(spark, sf_dir, folds=3):
    return written(split.test_fold(parts(spark, sf_dir)[0].drop("role"), folds), "folds")


#: The library's default is 100, as a user would ask for.
TRIALS = 20


def _weighted_folds(spark, sf_dir):
    """Training games with their fold and a weight that falls with their age."""
    return written(split.recency_weights(split.test_fold(parts(spark, sf_dir)[0].drop("role"), 3)), "weighted-folds")


@query("m11_parameter_search")
def m11(spark, sf_dir):
    """The ledger of a search: the better half of the trials goes on from fold to fold."""
    ledger = Ledger(spark, new_path(spark, "trials"))
    tune(_weighted_folds(spark, sf_dir), "logistic", FEATURES, ledger, "log_loss", trials=TRIALS, weight="sample_weight")
    return rounded(ledger.trials())


@query("m11_tuned_model", with_sql("games", f"""select game_id, is_home_win, true as is_chance from
    (select *, row_number() over (order by date, game_id) as rn, count(*) over () as n
     from games where pts_home is not null and date < date '{CUTOFF}') x where rn > round_even(n * 0.85, 0)"""))
def m11_tuned(spark, sf_dir):
    """The best trial of each of two families, fitted again on all weighted training games: every later game gets a chance from both."""
    folded, (_, scored) = _weighted_folds(spark, sf_dir), parts(spark, sf_dir)
    ledger, names = Ledger(spark, new_path(spark, "trials")), []
    for family in ("logistic", "bernoulli_bayes"):
        best = tune(folded, family, FEATURES, ledger, "log_loss", trials=6, weight="sample_weight")
        scored = learners.predict(best.model, scored, [c for c in scored.columns], f"proba_{family}")
        names.append(f"proba_{family}")
    ok = F.lit(True)
    for name in names:
        ok = ok & F.col(name).between(0, 1)
    return scored.select("game_id", "is_home_win", ok.alias("is_chance"))


@query("m12_calibration")
def m12(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    marked = split.hold_out(train.drop("role"), 0.2)
    model = learners.model_for("boosted", FEATURES).fit(marked.where("role = 'tune'"))
    held = learners.predict(model, marked.where("role = 'meta'"), ["is_home_win"])
    raw = learners.predict(model, test, ["game_id", "is_home_win"]).withColumn("raw", F.col("proba"))
    return rounded(learners.calibrated(learners.calibrator(held), raw))


@query("m14_weighted_average")
def m14(spark, sf_dir):
    """Weights from one half of the games; the other half is averaged and scored with them."""
    columns = ["proba_a", "proba_b", "proba_c"]
    scored = fx.pred(spark, sf_dir)
    half = F.pmod(F.xxhash64("game_id"), F.lit(2)) == 0
    weights, other = combine.fit_weights(scored.where(half), "is_home_win", columns), scored.where(~half)
    averaged = other.select("game_id", "is_home_win", combine.weighted(columns, weights).alias("proba"))
    score = metrics.evaluate(averaged, "is_home_win", "proba", ["log_loss"]).select(F.col("log_loss").alias("score"))
    return rounded(averaged.drop("is_home_win").join(F.broadcast(score)))  # one row


@query("m15_stacking")
def m15(spark, sf_dir):
    families, folded = ["logistic", "forest"], _folded(spark, sf_dir)
    _, test = parts(spark, sf_dir)
    oof = ensembles.out_of_fold(folded, families, FEATURES, 3)
    scored = ensembles.scored_by(folded, test, families, FEATURES)
    config = {"method": "stacking", "meta_model": "logistic"}
    stacked = ensembles.apply_ensemble(config, oof, scored, families, FEATURES)
    return rounded(stacked.select("game_id", "is_home_win", "proba"))


@query("m16_blending")
def m16(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return rounded(ensembles.blended(train, test, ["logistic", "gaussian_bayes"], FEATURES).select("game_id", "is_home_win", "proba"))


@query("m17_ensemble_sweep")
def m17(spark, sf_dir):
    return rounded(ensembles.sweep(_folded(spark, sf_dir), ["logistic", "gaussian_bayes"], FEATURES, 3))


@query("m22_feature_elimination")
def m22(spark, sf_dir):
    best, history = eliminate(_folded(spark, sf_dir, 2), FEATURES, ["forest"], folds=2, max_features=5, drop_share=0.4)
    return rounded(history.withColumn("chosen", F.col("features") == F.array(*[F.lit(f) for f in best])))


@query("m23_fold_importance")
def m23(spark, sf_dir):
    rows, _ = fold_importances(_folded(spark, sf_dir, 2), ["forest", "boosted"], FEATURES, 2, "accuracy")
    return rounded(mean_importance(spark, rows))


@query("m24_attribution")
def m24(spark, sf_dir):
    """All test games and features, two sampled orders walked both ways."""
    few = FEATURES
    train, test = parts(spark, sf_dir)
    model = learners.model_for("logistic", few).fit(train)
    means = train.agg(*[F.avg(c).alias(c) for c in few]).first().asDict()

    def score(rows):
        return learners.win_proba(model.transform(rows.select("*", *[F.lit(0.0).alias(f"{c}_missing") for c in few])))

    filled = test.select("game_id", *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in few])
    return rounded(attribution.sampled_attribution(filled, means, score, few, ["game_id"]))


@query("m26_walk_forward")
def m26(spark, sf_dir):
    """All months that have earlier games."""
    frame = narrow_frame(spark, sf_dir)
    scored = backtest.walk_forward(frame, FEATURES, ["logistic", "gaussian_bayes"], backtest.months_with_history(frame))
    return rounded(metrics.compare_models(written(scored.drop("month"), "backtest"), "is_home_win"))


@query("m27_upcoming_scores")
def m27(spark, sf_dir):
    names = ["win_pct_home", "win_pct_guest", "home_days_rest", "guest_days_rest"]
    train = narrow_frame(spark, sf_dir)
    models = {f: learners.model_for(f, names).fit(train) for f in ("logistic", "gaussian_bayes")}
    return rounded(upcoming.predict_upcoming(coming_frame(spark, sf_dir), models, names))


@query("m29_saved_run")
def m29(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    store = RunStore(spark, new_path(spark, "runs"), "run-1")
    store.save_model("logistic", learners.model_for("logistic", FEATURES).fit(train))
    store.save_settings("config", {"family": "logistic", "features": FEATURES, "threshold": 0.5})
    config = store.setting("config")
    scored = learners.predict(store.load_model(config["family"]), test, ["game_id", "is_home_win"], "proba_logistic")
    return rounded(scoring.with_classes(scored)).drop("label").withColumn("run_id", F.lit(store.run_id))
