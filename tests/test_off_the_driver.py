"""Tables with a row for each game are merged, however small Spark takes their files to be."""

import datetime

from tipoff.operators import views
from tipoff.plans import training
from tipoff.session import written


def games(spark):
    rows = [(g, datetime.date(2001, 1, 1) + datetime.timedelta(days=g), 2001, g % 3, (g + 1) % 3, 10.0 * (g % 3), 5.0, False, 100 + g, 103, 100 + g > 103)
            for g in range(8)]
    return written(spark.createDataFrame(rows, "game_id long, date date, season_id int, home_team int, guest_team int, latitude double, longitude double, "
                                               "is_playoff_game boolean, pts_home long, pts_guest long, is_home_win boolean"), "played")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_schedule_features_are_merged(spark):
    frame = training.schedule_features(games(spark))
    # the share of close games is left to Spark, as another join would change the order of games that come twice
    joins = [line for line in plan(frame).splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftOuter" in line and ", team#" in line for line in joins)
    found = {r.game_id: r for r in frame.collect()}
    assert sorted(found) == list(range(8)) and found[0].home_days_rest is None and found[1].home_days_rest == 1


def test_sides_of_blocks_are_merged(spark):
    played = games(spark)
    block = written(spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.5), (1, 1, 3.5), (1, 7, 9.5)], "game_id long, team int, x double"), "block")
    sided = written(views.with_side(block, played), "sided")
    frame = views.attach_sides(played.select("game_id"), sided)
    assert "Broadcast" not in plan(views.with_side(block, played)) and "Broadcast" not in plan(frame)
    found = {r.game_id: (r.x_home, r.x_guest) for r in frame.collect()}
    assert found[0] == (1.5, 2.5) and found[1] == (3.5, None) and found[2] == (None, None) and len(found) == 8
