"""Changing the score of a game must not change any feature of that game or of an earlier one."""

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.operators import records, schedule
from tipoff.plans.training import TEAM_OWN
from tipoff.operators import form, views


def features(games):
    parts = records.overall_record(games).drop("is_home_win")
    clutch = schedule.clutch(games).select("game_id", "clutch_win_pct_home", "clutch_win_pct_guest")
    team = form.team_form(views.derived_box(views.team_boxscores(games, TEAM_OWN))).drop("is_win", "date", "season_id")
    frame = views.attach_roles(parts.join(clutch, "game_id"), team.select(
        "game_id", "team", "has_won_last_game", "current_winning_streak", "pts_7", "pts_ewm_109", "off_rtg_109_std", "ts_pct_7_std"))
    return {r.game_id: r for r in frame.collect()}


def test_no_feature_sees_its_own_game(spark, sf_dir):
    games = fx.games(spark, sf_dir).where("pts_home is not null and season_id = 1997").cache()
    middle = games.orderBy("date", "game_id").limit(120).orderBy(F.desc("date"), F.desc("game_id")).first()
    swapped = games.withColumns({
        c: F.when(F.col("game_id") == middle.game_id, F.lit(500)).otherwise(F.col(c))
        for c in ("pts_home", "off_rtg_home", "fg_home")
    }).withColumn("is_home_win", F.col("pts_home") > F.col("pts_guest"))
    before, after = features(games), features(swapped)
    at = (middle.date, middle.game_id)
    earlier = [g for g, r in before.items() if (r.date, g) <= at]
    assert len(earlier) == 120
    assert all(before[g] == after[g] for g in earlier)
    assert any(before[g] != after[g] for g in before if g not in earlier)
