"""Team form that is rounded in the tasks that make it has the values that rounding the whole frame gives, in the same columns."""

import datetime
import random

from pyspark.sql import functions as F

from tipoff.operators import views
from tipoff.plans import training
from tipoff.queries.base import nudged, rounded

OWN = sorted({*training.TEAM_OWN, *views.OPPONENT_STATS})


def games(spark):
    rng = random.Random(3)
    rows = [(g, datetime.date(2001, 1, 1) + datetime.timedelta(days=g // 2), 2001, g % 4, (g + 1 + g // 4 % 3) % 4, 1.0, 2.0, False, g % 3 == 0,
             *[None if rng.random() < 0.05 else rng.randint(-9, 60) / 7 for _ in OWN], *[float(rng.randint(0, 40)) for _ in OWN])
            for g in range(60)]
    stats = [f"{c}_{side} double" for side in ("home", "guest") for c in OWN]
    return spark.createDataFrame(rows, "game_id long, date date, season_id int, home_team int, guest_team int, latitude double, longitude double, "
                                       f"is_playoff_game boolean, is_home_win boolean, {', '.join(stats)}").fillna(0.0, ["pts_home", "pts_guest"])


def test_rounding_in_the_form_tasks_is_that_of_the_columns(spark):
    plain = rounded(training.team_block(games(spark)), nudge=True).orderBy("game_id", "team").collect()
    finished = training.team_block(games(spark), finish=nudged()).orderBy("game_id", "team").collect()
    assert finished == plain and len(plain) == 120


def test_frame_keeps_its_columns_and_rounds_the_rest(spark):
    played = games(spark)
    rated = played.select("game_id", "date", "season_id", F.col("home_team").alias("team_id"), (F.col("game_id") / 7).alias("elo_before"))
    frame = training.training_frame(played, None, rated, finish=nudged())
    form = [c for c in training.team_block(played).columns if c not in ("game_id", "side", "team")]
    elo = ["elo", "elo_change_7_absolute", "elo_change_7_relative"]
    tail = [f"{c}_{side}" for block in (form, elo) for side in ("home", "guest") for c in block]
    assert frame.columns[-len(tail):] == tail and not {c for c in frame.columns if frame.columns.count(c) > 1}
    done = frozenset(f"{c}_{side}" for c in form for side in ("home", "guest"))
    whole = rounded(training.training_frame(played, None, rated), nudge=done).orderBy("game_id").collect()
    assert rounded(frame, done=done).orderBy("game_id").collect() == whole and len(whole) == 60
