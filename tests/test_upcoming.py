"""Upcoming games of teams that have no roster or no rating yet stay in the frame."""

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.operators import ratings, relational
from tipoff.plans import upcoming
from tipoff.queries.rating import league_games


def test_scenario_pairs_keep_teams_without_scenarios(spark):
    games = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "game_id long, home_team long, guest_team long")
    scenarios = spark.createDataFrame([(10, 0, 1.5), (10, 1, 2.5), (30, 0, 3.5)], "team_id long, scenario_id long, exp_pts double")
    out = relational.scenario_pairs(games, scenarios, "left").select("game_id", "exp_pts_home", "exp_pts_guest")
    assert sorted(map(tuple, out.collect())) == [(1, 1.5, None), (1, 2.5, None), (2, 3.5, None)]
    assert relational.scenario_pairs(games, scenarios).count() == 0


def test_games_of_new_teams_stay(spark, sf_dir):
    games = fx.season_games(spark, sf_dir)
    newest = games.agg(F.max("season_id")).first()[0]
    season = games.where(F.col("season_id") == newest)
    coming = {r.game_id: r for r in relational.upcoming_games(season, season.where("pts_home is not null")).collect()}
    assert coming
    new = next(iter(coming.values()))
    rated = ratings.elo(league_games(spark, sf_dir).drop("league")).where(F.col("team_id") != new.home_team)
    roster = fx.roster(spark, sf_dir).where(F.col("team_id") != new.guest_team)
    frame = upcoming.upcoming_frame(games, fx.player_box(spark, sf_dir), rated, roster)
    rows = frame.select("game_id", "elo_home", "elo_guest", "elo_change_7_relative_home", "exp_pts_guest", "num_players_guest").collect()
    assert {r.game_id for r in rows} == set(coming)
    of_new = [r for r in rows if r.game_id == new.game_id]
    assert of_new and all(r.elo_home == ratings.START and r.elo_change_7_relative_home is None for r in of_new)
    assert all(r.exp_pts_guest is None and r.num_players_guest is None for r in of_new)
    assert all(r.elo_home is not None and r.elo_guest is not None for r in rows)
