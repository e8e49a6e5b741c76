"""The skew-safe building blocks must equal plain windows, also when one entity holds most rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tipoff.operators import form
from tipoff.operators.ordered import TEAM_SEASON, blocks, running, with_ordinal


@pytest.fixture(scope="module")
def skewed(spark):
    """Team 0 has 400 games on 60 dates, the other four have 30 each; some values are missing."""
    rng, rows, game = random.Random(7), [], 0
    for team, n in ((0, 400), (1, 30), (2, 30), (3, 30), (4, 30)):
        for _ in range(n):
            game += 1
            day = datetime.date(2000, 1, 1) + datetime.timedelta(days=rng.randrange(60))
            x = None if rng.random() < 0.1 else float(rng.randrange(40))
            won = None if rng.random() < 0.05 else rng.random() < 0.6
            rows.append((2000, team, day, game, x, won))
    df = spark.createDataFrame(rows, "season_id int, team int, date date, game_id long, x double, is_win boolean")
    return df.cache()


def plain_window():
    return Window.partitionBy("season_id", "team").orderBy("date", "game_id")


def same(a, b, keys=("team", "game_id")):
    left = sorted(a.collect(), key=lambda r: tuple(r[k] for k in keys))
    right = sorted(b.select(*a.columns).collect(), key=lambda r: tuple(r[k] for k in keys))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for c in a.columns:
            if isinstance(x[c], float) and isinstance(y[c], float):
                assert math.isclose(x[c], y[c], rel_tol=1e-9, abs_tol=1e-9), (c, x, y)
            else:
                assert x[c] == y[c], (c, x, y)


def test_running_equals_window(skewed):
    before = plain_window().rowsBetween(Window.unboundedPreceding, -1)
    mine = running(skewed, TEAM_SEASON, sums={"s": F.col("x")}, lasts={"l": F.col("x")}, totals={"n": F.lit(1)})
    plain = skewed.select("*", F.coalesce(F.sum("x").over(before), F.lit(0.0)).alias("s"),
                          F.last("x", True).over(before).alias("l"),
                          F.count(F.lit(1)).over(Window.partitionBy("season_id", "team")).alias("n"))
    same(mine, plain)


def test_no_block_is_larger_than_its_bound(skewed):
    spread = blocks(with_ordinal(skewed, TEAM_SEASON), halo=10, size=32)
    sizes = [r["count"] for r in spread.groupBy("team", "__block").count().collect()]
    assert max(sizes) <= 42
    assert spread.where("__block = __home").count() == skewed.count()


def test_rolling_over_blocks(skewed):
    f = form.Form(form.placed(skewed, TEAM_SEASON, [3, 9], spans=[3, 9], size=32), TEAM_SEASON)
    f.lagged(["x"]).rolling(["x"], [3, 9], lambda c, w: 2).weighted(["x"], [3], lambda c, w: 1)
    mine = f.done(["team", "game_id", "x_previous_game", "x_3", "x_9", "x_3_std", "x_9_std"])
    columns = [F.lag("x").over(plain_window()).alias("x_previous_game")]
    for w in (3, 9):
        frame = plain_window().rowsBetween(-w, -1)
        enough = F.count("x").over(frame) >= 2
        columns += [F.when(enough, F.avg("x").over(frame)).alias(f"x_{w}"),
                    F.when(enough, F.stddev_samp("x").over(frame)).alias(f"x_{w}_std")]
    same(mine, skewed.select("team", "game_id", *columns))


def test_weighted_mean_by_hand(skewed):
    f = form.Form(form.placed(skewed, TEAM_SEASON, [3], spans=[3, 9], size=32), TEAM_SEASON)
    got = {(r.team, r.game_id): (r.a, r.b) for r in f.weighted(["x"], [3, 9], lambda c, w: 1).done(
        ["team", "game_id", F.col("x_ewm_3").alias("a"), F.col("x_ewm_9").alias("b")]).collect()}
    history = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.team, r.date, r.game_id)):
        past = history.setdefault(r.team, [])
        for value, span in zip(got[r.team, r.game_id], (3, 9)):
            keep = 1 - 2 / (span + 1)
            pairs = [(keep ** i, v) for i, v in enumerate(reversed(past)) if v is not None]
            want = sum(w * v for w, v in pairs) / sum(w for w, _ in pairs) if pairs else None
            assert (value is None) == (want is None)
            assert value is None or math.isclose(value, want, rel_tol=1e-9)
        past.append(r.x)


def test_streaks_over_blocks(skewed):
    got = {(r.team, r.game_id): r for r in form.streaks(skewed).collect()}
    past = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.team, r.date, r.game_id)):
        done = past.setdefault(r.team, [])
        last = done[-1] if done else None
        n = 0
        while n < len(done) and done[-1 - n] == last:
            n += 1
        mine = got[r.team, r.game_id]
        assert mine.has_won_last_game == last
        assert (mine.current_winning_streak, mine.current_losing_streak) == (
            n if last is True else 0, n if last is False else 0)
        done.append(r.is_win)


def test_arrow_block_equals_jvm_windows(skewed):
    """Both implementations of the rolling maths, on blocks much smaller than the entity."""
    rows = skewed.select("game_id", "date", "season_id", F.col("team").alias("player_id"), F.lit(1).alias("team_id"), "x")
    line = form.PLAYER_SEASON
    arrow = form.player_form(rows, (3, 9), impute=False, size=32, stats=["x"])
    f = form.Form(form.placed(rows, line, [3, 9], spans=[3, 9], size=32), line)
    strict = lambda c, w: form.min_games(w, False)
    f.lagged(["x"]).rolling(["x"], [3, 9], strict).weighted(["x"], [3, 9], strict)
    same(arrow, f.done(arrow.columns), keys=("player_id", "game_id"))


def test_running_keeps_rows_with_null_keys_and_dates(spark):
    from pyspark.sql import functions as F
    from tipoff.operators.ordered import Timeline, running

    rows = [(1, "a", "2000-01-01", 1), (2, "a", "2000-01-02", 2), (3, "a", None, 4), (4, None, "2000-01-01", 8), (5, None, "2000-01-03", 16), (6, "a", None, 32)]
    df = spark.createDataFrame(rows, "game_id long, team string, date string, x long").withColumn("date", F.col("date").cast("date"))
    got = {r.game_id: (r.s, r.t) for r in running(df, Timeline(("team",)), sums={"s": F.col("x")}, totals={"t": F.col("x")}).collect()}
    assert got == {3: (0, 39), 6: (4, 39), 1: (36, 39), 2: (37, 39), 4: (0, 24), 5: (8, 24)}


def test_shuffle_key_takes_any_id(spark):
    from pyspark.sql import functions as F
    from tipoff.ml.split import shuffle_key, stratified_folds, test_fold

    big = spark.createDataFrame([(4_000_000_000,), (9_007_199_254_740_993,), (-5,), (2**63 - 1,)], "id long")
    want = {i: (i % 2**32) * 2654435761 % 2**32 for i in (4_000_000_000, 9_007_199_254_740_993, -5, 2**63 - 1)}
    assert {r.id: r.h for r in big.select("id", shuffle_key(big, "id").alias("h")).collect()} == want
    text = spark.createDataFrame([(f"g{k}", k % 2 == 0) for k in range(40)] + [("n", None)], "game_id string, win boolean")
    folds = stratified_folds(text, "win", folds=4).collect()
    assert len(folds) == 41 and {sum(r.fold == f and r.win is True for r in folds) for f in range(4)} == {5}
    few = spark.createDataFrame([(1, "2000-01-01")], "game_id long, date string").withColumn("date", F.col("date").cast("date"))
    assert [r.fold for r in test_fold(few, 5).collect()] == [None]


def test_undefined_score_is_the_worst(spark):
    from tipoff.ml.metrics import score

    none = spark.createDataFrame([], "y boolean, p double")
    assert score(none, "y", "p", "log_loss") == score(none, "y", "p", "brier_score") == float("inf")
    assert score(none, "y", "p", "neg_log_loss") == float("-inf") and score(none, "y", "p", "f1") == score(none, "y", "p", "roc_auc") == 0.0
