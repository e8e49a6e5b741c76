"""Player form without ordinals for short entities, and line-up inputs that are shuffled once."""

import datetime

import pytest
from pyspark.sql import functions as F

from tipoff.operators import form, lineup


@pytest.fixture
def rows(spark):
    """Players with 1, 30 and 5 games; one has no id."""
    start, out = datetime.date(2020, 1, 1), []
    for player, games in ((1, 1), (2, 30), (3, 5), (None, 12)):
        for k in range(games):
            out.append((1000 * (player or 9) + k, start + datetime.timedelta(days=k // 2), 2020, player, (player or 0) % 2,
                        *[float((k * 7 + j * (player or 4)) % 11) if (k + j) % 6 else None for j in range(len(form.PLAYER_STATS))]))
    schema = "game_id long, date date, season_id int, player_id long, team_id int, " + ", ".join(f"{c} double" for c in form.PLAYER_STATS)
    return spark.createDataFrame(out, schema)


def _values(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_blocks_or_whole_entities(rows):
    whole = form.player_form(rows, (3, 9), impute=False, size=100)  # no entity is longer than a block
    cut = form.player_form(rows, (3, 9), impute=False, size=8)
    assert _values(whole) == _values(cut) and whole.count() == rows.count()


def test_wanted_columns_are_those_of_all(rows):
    some = ["pts_3", "pts_9_std", "mp_previous_game", "fg_ewm_9", "fg_9"]
    keys = ["game_id", "date", "season_id", "player_id", "team_id"]
    found = form.player_form(rows, (3, 9), impute=False, columns=some)
    everything = form.player_form(rows, (3, 9), impute=False)
    assert set(found.columns) == {*keys, *some}
    assert _values(found) == _values(everything.select(*found.columns))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_short_entities_are_shuffled_once(rows):
    assert len(_exchanges(form.player_form(rows))) == 1


def test_sides_of_a_game_without_more_shuffles(spark, rows):
    games = rows.select("game_id").distinct().select("game_id", F.lit(0).alias("home_team"), F.lit(1).alias("guest_team"))
    players = form.player_form(rows, columns=lineup.FORM_COLUMNS).localCheckpoint()
    twice = lineup.home_away_features(players, spark.createDataFrame(games.unionByName(games).collect(), games.schema))
    assert len(_exchanges(twice)) == 2  # players by their inputs, and the games
    assert not any(f"{s}_7#" in line for line in _exchanges(twice) for s in lineup.COUNTING)


def test_both_sides_and_games_that_come_twice(spark, rows):
    pair = rows.where("player_id is not null").withColumn("game_id", F.col("game_id") % 1000).withColumn(
        "team_id", F.when(F.col("player_id") == 2, 0).otherwise(1))  # games 0 to 4 have both teams
    players = form.player_form(pair, columns=lineup.FORM_COLUMNS)
    games = spark.createDataFrame([(k, 0, 1) for k in range(30)] + [(3, 0, 1), (4, 1, 0), (2, None, 1)], "game_id long, home_team int, guest_team int")
    found = lineup.home_away_features(players, games)
    stats = {(r.game_id, r.team_id): r.exp_pts for r in lineup.expected_team_stats(players).collect()}
    got = sorted((r.game_id, r.home_exp_pts, r.away_exp_pts) for r in found.collect())
    wanted = [(g, stats[g, h], stats[g, a]) for g, h, a in [(k, 0, 1) for k in range(30)] + [(3, 0, 1), (4, 1, 0)] if (g, h) in stats and (g, a) in stats]
    assert got == sorted(wanted) and len(got) > 4
