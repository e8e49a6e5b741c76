"""Small inputs with results worked out by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tipoff.functions import scalar as S
from tipoff.ml import attribution, combine, metrics, split
from tipoff.operators import lineup, ratings, records, relational, schedule

D = datetime.date
GAMES = "game_id long, date date, season_id int, home_team int, guest_team int, pts_home double, pts_guest double"


def games(spark, rows):
    df = spark.createDataFrame(rows, GAMES)
    return df.withColumn("is_home_win", S.home_win("pts_home", "pts_guest"))


@pytest.fixture(scope="module")
def league(spark):
    """Three teams, a tie (game 3) and a game still to come (game 5)."""
    return games(spark, [
        (1, D(2000, 1, 1), 2000, 1, 2, 100.0, 90.0), (2, D(2000, 1, 2), 2000, 2, 3, 80.0, 95.0),
        (3, D(2000, 1, 3), 2000, 3, 1, 88.0, 88.0), (4, D(2000, 1, 4), 2000, 1, 2, 70.0, 71.0),
        (5, D(2000, 1, 5), 2000, 2, 1, None, None), (6, D(2000, 1, 6), 2000, 1, 2, 99.0, 98.0)])


def by_game(df):
    return {r.game_id: r for r in df.collect()}


def test_records(league):
    r = by_game(records.overall_record(league))
    assert (r[1].wins_this_year_home_team, r[1].games_this_year_home_team, r[1].win_pct_home) == (0, 0, None)
    assert (r[4].wins_this_year_home_team, r[4].games_this_year_home_team) == (2, 2)  # a tie is a guest win
    # the unplayed game counts as a game but changes no record
    assert (r[6].wins_this_year_home_team, r[6].games_this_year_home_team) == (2, 4)
    h = by_game(records.head_to_head(league))
    assert (h[6].h2h_wins_home, h[6].h2h_wins_guest, h[6].h2h_games) == (1, 1, 3)
    away = by_game(records.location_record(league))
    assert (away[4].away_games_this_year_guest_team, away[6].away_wins_this_year_guest_team) == (1, 1)


def test_team_records_leave_out_blank_rows(league):
    first_unplayed = league.where("game_id = 5")
    assert records.team_records(first_unplayed).count() == 0
    assert records.team_records(league).count() == 12


def test_rest_and_density(spark):
    df = games(spark, [(i, d, 2000, 1, 10 + i, 1.0, 0.0) for i, d in enumerate(
        (D(2000, 1, 1), D(2000, 1, 3), D(2000, 1, 5), D(2000, 1, 6)))])
    r = by_game(schedule.rest(df))
    assert r[0].home_days_rest is None and r[0].is_b2b_home is None
    assert (r[3].home_days_rest, r[3].is_b2b_home) == (1, True)
    # the 3rd lies exactly 3 days and the 1st exactly 5 days before the 6th
    assert (r[3].home_games_last_3_density, r[3].home_games_last_5_density) == (2, 3)


def test_travel_window_includes_day_seven(spark):
    places = {0: (0.0, 0.0), 1: (0.0, 1.0)}
    degree = 6371.0 * math.pi / 180
    days = [(1, D(2000, 1, 1), 0), (2, D(2000, 1, 2), 1), (3, D(2000, 1, 9), 0), (4, D(2000, 1, 10), 1), (5, D(2000, 1, 10), 0)]
    rows = [(g, d, 2000, 1, 100 + g, 1.0, 0.0) for g, d, _ in days]
    where = {g: places[p] for g, _, p in days}
    df = games(spark, rows)
    lat = spark.createDataFrame([(g, *v) for g, v in where.items()], "game_id long, latitude double, longitude double")
    r = by_game(schedule.travel(df.join(lat, "game_id")))
    assert r[1].home_km_since_last_game == 0.0
    assert r[3].home_km_last_7_days == round(2 * degree, 2)  # Jan 2 is day -7 of Jan 9
    assert r[4].home_km_last_7_days == round(2 * degree, 2)  # Jan 2 is out; game 5 of the same day comes later
    assert r[5].home_km_last_7_days == round(3 * degree, 2)
    assert r[5].home_km_season_total == round(4 * degree, 2)


def test_clutch_margins(spark):
    df = games(spark, [(1, D(2000, 1, 1), 2000, 1, 2, 80.0, 80.0), (2, D(2000, 1, 2), 2000, 1, 2, 85.0, 80.0),
                       (3, D(2000, 1, 3), 2000, 1, 2, 80.0, 86.0), (4, D(2000, 1, 4), 2000, 1, 2, 80.0, 84.0),
                       (5, D(2000, 1, 5), 2000, 1, 2, 90.0, 70.0)])
    r = by_game(schedule.clutch(df))
    assert [r[i].is_clutch_game for i in range(1, 6)] == [False, True, False, True, False]
    assert [r[i].clutch_win_pct_home for i in range(1, 6)] == [None, None, 1.0, 1.0, 0.5]


def test_elo_by_hand(spark):
    df = games(spark, [(1, D(2000, 1, 1), 2000, 1, 2, 100.0, 90.0), (2, D(2001, 1, 1), 2001, 2, 1, 90.0, 100.0)])
    rows = {(r.game_id, r.team_id): r for r in ratings.elo(df).collect()}
    gain = 20 * (13 ** 0.8 / (7.5 + 0.006 * 100)) * (1 - 1 / (1 + 10 ** (-100 / 400)))
    assert math.isclose(rows[1, 1].elo_after, 1500 + gain) and math.isclose(rows[1, 2].elo_after, 1500 - gain)
    start1, start2 = 0.75 * (1500 + gain) + 0.25 * 1505, 0.75 * (1500 - gain) + 0.25 * 1505
    assert math.isclose(rows[2, 1].elo_before, start1)
    edge = start2 + 100 - start1  # the host is favoured and loses
    loss = 20 * (13 ** 0.8 / (7.5 - 0.006 * abs(edge))) / (1 + 10 ** (-edge / 400))
    assert math.isclose(rows[2, 2].elo_after, start2 - loss)


def test_elo_update_equals_full_run(spark, sf_dir):
    from tipoff.queries.rating import league_games

    all_games = league_games(spark, sf_dir).where("pts_home is not null")
    full = ratings.elo(all_games).cache()
    known = full.where("date < date '2001-04-01'")
    fresh = {(r.game_id, r.team_id): r.elo_after for r in ratings.elo_update(all_games, known).collect()}
    want = {(r.game_id, r.team_id): r.elo_after for r in full.where("date >= date '2001-04-01'").collect()}
    assert fresh.keys() == want.keys() and len(fresh) > 0
    assert all(math.isclose(fresh[k], want[k]) for k in want)
    drift = full.groupBy("game_id").agg(F.sum(F.col("elo_after") - F.col("elo_before")).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert drift < 1e-9


def test_roster_scenarios(spark):
    rows = [(1, 1, "a", None), (1, 2, "b", "Day-To-Day"), (1, 3, "c", "Day-To-Day knee"), (1, 4, "d", "Out"), (1, 5, "e", None)]
    roster = spark.createDataFrame(rows, "team_id long, player_id long, player_name string, injury string")
    got = {}
    for r in lineup.roster_scenarios(roster).collect():
        got.setdefault(r.scenario_id, set()).add(r.player_id)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 5], [1, 2, 5], [1, 3, 5], [1, 5]]
    many = [(2, p, "x", "Day-To-Day") for p in range(12)] + [(2, 99, "y", None)]
    squads = lineup.roster_scenarios(spark.createDataFrame(many, roster.schema))
    assert squads.select("scenario_id").distinct().count() == 2**12


def test_minutes_and_ranks(spark):
    rows = [(1, 1, p, m) for p, m in ((1, 40.0), (2, 40.0), (3, 30.0), (4, 0.0), (5, 10.0))]
    df = spark.createDataFrame(rows, "game_id long, team_id long, player_id long, historical_minutes double")
    ranked = {r.player_id: (r.place, r.minutes_rank) for r in lineup.ranked(df).collect()}
    assert ranked == {1: (1, 1.5), 2: (2, 1.5), 3: (3, 3.0), 5: (4, 4.0), 4: (5, 5.0)}
    given = {r.player_id: r.expected_minutes for r in lineup.expected_minutes(df).collect()}
    assert math.isclose(sum(given.values()), 240.0)
    # 80, 80, 60, 0, 20 -> 48, 48, 48, 0, 20 -> scaled to 240, beyond the cap
    assert math.isclose(given[1], 48 * 240 / 164) and given[4] == 0.0


def test_auc_and_thresholds_with_ties(spark):
    rows = [(True, 0.5), (True, 0.5), (False, 0.5), (False, 0.2), (True, 0.9), (None, 0.7)]
    df = spark.createDataFrame(rows, "y boolean, p double")
    # pairs: 0.9 beats both, the two 0.5 tie with 0.5 and beat 0.2
    assert math.isclose(metrics.roc_auc(df, "y", "p").first()[0], (2 + 2 * 1.5) / 6)
    best = metrics.best_threshold(df, "y", "p", "f1").first()
    assert math.isclose(best.threshold, 0.21) and math.isclose(best.score, 6 / 7)
    with pytest.raises(ValueError):
        metrics.best_threshold(df, "y", "p", "log_loss")
    exact = {r.threshold: r.tp for r in metrics.threshold_scores(
        spark.createDataFrame([(True, k / 100) for k in range(101)], "y boolean, p double"), "y", "p").collect()}
    assert all(exact[k / 100] == 101 - k for k in range(1, 100))


def test_folds_expand(spark):
    df = spark.createDataFrame([(i, D(2000, 1, 1) + datetime.timedelta(days=i // 3)) for i in range(20)], "game_id long, date date")
    folds = split.expanding_folds(df, 3).collect()
    for f in range(3):
        test = sorted(r.game_id for r in folds if r.fold == f and r.role == "test")
        train = sorted(r.game_id for r in folds if r.fold == f and r.role == "train")
        assert test == list(range(5 + 5 * f, 10 + 5 * f)) and train == list(range(5 + 5 * f))
    tested = {r.game_id: r.fold for r in split.test_fold(df, 3).collect()}
    assert [tested[i] for i in (0, 4, 5, 10, 19)] == [None, None, 0, 1, 2]


def test_attributions_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, -1.0, 4.0)], "game_id long, a double, b double")

    def score(rows):
        return rows.withColumn("proba", F.col("a") * F.col("b") + F.col("a"))

    got = attribution.sampled_attribution(df, {"a": 1.0, "b": 1.0}, score, ["a", "b"], ["game_id"], permutations=3)
    for r in got.collect():
        a, b = {1: (2.0, 3.0), 2: (-1.0, 4.0)}[r.game_id]
        assert math.isclose(r.a + r.b, a * b + a - 2.0)
        assert math.isclose(r.a, ((a + a - 2) + (a * b + a - (b + 1))) / 2)  # both orders of two features


def test_votes_and_weights(spark):
    df = spark.createDataFrame([(True, 0.6, 0.4, 0.7), (False, 0.4, 0.6, 0.1)], "y boolean, a double, b double, c double")
    assert [r[0] for r in df.select(combine.hard_vote(["a", "b", "c"])).collect()] == [True, False]
    assert [r[0] for r in df.select(combine.hard_vote(["a", "b"])).collect()] == [False, False]
    weights, _ = combine.search_weights(df, "y", ["a", "b", "c"], "log_loss", n=50)
    assert weights == [0.0, 0.0, 1.0]


def test_text_parsing(spark):
    df = spark.createDataFrame([("Tue, Oct 21, 2025", "34:30", "7"), ("soon", "Did Not Play", "x"), (None, None, "")], "d string, m string, n string")
    got = df.select(S.long_date("d"), S.minutes("m"), S.number("n")).collect()
    assert tuple(got[0]) == (D(2025, 10, 21), 34.5, 7.0)
    assert tuple(got[1]) == (None, None, None) and tuple(got[2]) == (None, None, None)


def test_player_join_must_give_rows(spark):
    basic = spark.createDataFrame([(1, "a", 10.0), (1, "b", None), (2, "c", None)], "game_id long, player_name string, mp double")
    joined = relational.keyed_on_values(basic, basic.withColumn("bpm", F.lit(1.0)), ["game_id", "player_name", "mp"])
    assert [(r.game_id, r.player_name) for r in joined.collect()] == [(1, "a")]  # a NULL key never matches
    kept = relational.require_rows(joined, basic.where("game_id = 1"), "game_id", "no rows")
    assert kept.count() == 1
    with pytest.raises(ValueError, match="no rows: 2"):
        relational.require_rows(joined, basic, "game_id", "no rows")


def test_record_stream_counts_repeated_and_late_games_once(spark):
    from tipoff.streaming.records import SEEN, records_batch

    schema = "game_id long, date string, season_id int, home_team int, guest_team int, is_home_win boolean"

    def batch(*rows):
        return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))

    first, again = (1, "2000-01-01", 2000, 1, 2, True), (3, "2000-01-05", 2000, 1, 2, True)
    late, unplayed = (2, "2000-01-03", 2000, 2, 1, False), (4, "2000-01-07", 2000, 1, 2, None)
    played = (*unplayed[:5], True)
    seen = batch().select(*SEEN)
    told = {}
    for rows in ((first, again), (again, late, unplayed), (played, late), ((5, "2000-01-09", 2000, 1, 2, None),)):
        out, kept = records_batch(batch(*rows), seen)
        for r in out.collect():
            assert r.id not in told
            told[r.id] = (r.wins_before, r.losses_before)
        seen = spark.createDataFrame(seen.unionByName(kept.select(*SEEN)).collect(), seen.schema)
    assert {k: told[f"{k}_1"] for k in (1, 2, 3, 4, 5)} == {1: (0, 0), 3: (1, 0), 2: (1, 0), 4: (3, 0), 5: (4, 0)}
