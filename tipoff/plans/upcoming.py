"""Features and predictions for the games that come next."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.ml.learners import prepared, predict
from tipoff.ml.scoring import scenario_mean, with_classes
from tipoff.operators import form, lineup, ratings, relational, views
from tipoff.plans.training import schedule_features, team_block
from tipoff.session import written
from tipoff.sources.tables import new_rows


def upcoming_frame(games: DataFrame, player_box: DataFrame, rated: DataFrame, roster: DataFrame,
                   predicted: DataFrame | None = None, top_n: int = 10) -> DataFrame:
    """One row per upcoming game, home scenario and guest scenario; empty when there is nothing to predict.

    Form comes from the newest season; line-up strength from each rostered player's latest form in it. A team without a roster, or without a rostered
    player who has a form, has one scenario of NULL columns; a team without a rating has the starting one and NULL changes.
    """
    newest = F.broadcast(games.agg(F.max("season_id").alias("season_id")))  # one row
    season = written(games.join(newest, "season_id", "left_semi"), "season")
    played = season.where(F.col("pts_home").isNotNull())
    coming = relational.upcoming_games(season, played).select("game_id", "home_team", "guest_team")
    if predicted is not None:
        coming = new_rows(coming, predicted, ["game_id"])

    frame = schedule_features(season).join(coming.select("game_id"), "game_id", "left_semi")
    teams = views.home_guest_sides(coming).select("game_id", "team")
    blocks = written(team_block(season).join(teams, ["game_id", "team"], "left_semi"), "team-form")
    frame = views.attach_sides(frame, blocks)

    players = form.player_form(written(player_box.join(newest, "season_id", "left_semi"), "player-box"), columns=lineup.FORM_COLUMNS)
    squads = roster.join(teams.select(F.col("team").alias("team_id")).distinct(), "team_id", "left_semi")  # before subsets are made
    scenarios = written(lineup.scenario_stats(squads, written(players, "player-form"), top_n), "scenarios")
    frame = relational.scenario_pairs(frame, scenarios, "left")

    now = ratings.current_elo(rated).withColumnRenamed("elo_after", "elo")
    for side in ("home", "guest"):
        named = now.select(F.col("team_id").alias(f"{side}_team"),
                           *[F.col(c).alias(f"{c}_{side}") for c in now.columns if c != "team_id"])
        frame = frame.join(named, f"{side}_team", "left").withColumn(
            f"elo_{side}", F.coalesce(f"elo_{side}", F.lit(ratings.START)))
    return frame


def predict_upcoming(frame: DataFrame, models: dict[str, PipelineModel], features: list[str]) -> DataFrame:
    """Probabilities of all models, averaged over the scenarios of a game, with the predicted class."""
    keys = ["game_id", "home_team", "guest_team", "is_home_win"]
    open_label = F.coalesce(F.col("is_home_win"), F.lit(False))
    scored = prepared(frame.withColumn("__open", open_label), features, "__open").drop("__open")
    inputs = [*keys, *features, *[f"{c}_missing" for c in features]]
    scored, names = scored.select(*inputs), []
    for name, model in models.items():
        scored = predict(model, scored, [*inputs, *names], f"proba_{name}")
        names.append(f"proba_{name}")
    return with_classes(scenario_mean(scored, keys, names)).drop("home_team", "guest_team")
