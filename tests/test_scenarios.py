"""Line-up scenarios: merged equal players and summed-up squads give the results of all subsets, and leagues bound the number of subsets."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.operators import lineup as L
from tipoff.queries.base import ORACLES, QUERIES, rounded

STATS = ["mp", *L.COUNTING, *L.RATES]
FEATURES = [f"{s}_{k}" for s in STATS for k in ("previous_game", "7", "109", "7_std", "109_std")]


def _player(rng, minutes=None):
    """Whole numbers with many ties; some values are NULL."""
    values = {f: None if rng.random() < 0.1 else float(rng.randint(0, 6)) for f in FEATURES}
    return values | {"mp_7": float(rng.randint(5, 9)) if minutes is None else minutes, "mp_109": 7.0}


def _squads(spark):
    rng = random.Random(3)
    equal, unknown = _player(rng), dict.fromkeys(FEATURES)
    teams = {
        1: [(_player(rng), None) for _ in range(16)] + [(_player(rng), "Day-To-Day") for _ in range(3)],  # more than a rotation
        2: [(_player(rng), None) for _ in range(4)] + [(equal, "Day-To-Day")] * 3 + [(unknown, "Day-To-Day")] + [(_player(rng), "Out")],
        3: [(_player(rng, 8.0), None) for _ in range(14)] + [(_player(rng, 8.0), "Day-To-Day")] * 2,  # all tied in minutes
        4: [(_player(rng), "Day-To-Day") for _ in range(2)],  # nobody healthy
        5: [(_player(rng), None)],
    }
    roster, form = [], []
    for team, players in teams.items():
        for k, (values, injury) in enumerate(players):
            roster.append((team, 100 * team + k, f"p{k}", injury))
            form.append((100 * team + k, 9, *[values[f] for f in FEATURES]))
    columns = ", ".join(f"{f} double" for f in FEATURES)
    known = spark.createDataFrame(form, f"player_id long, game_id long, {columns}").withColumn("date", F.lit("2001-01-01").cast("date"))
    return spark.createDataFrame(roster, "team_id long, player_id long, player_name string, injury string"), known


def _plain(roster, known, top_n):
    """All subsets, every player copied."""
    rows = L.roster_scenarios(roster).join(known.drop("game_id", "date"), "player_id")
    return L.expected_team_stats(rows, top_n, keys=("team_id", "scenario_id")).drop("scenario_id")


@pytest.mark.parametrize("top_n", [3, 10])
def test_results_are_those_of_all_subsets(spark, top_n):
    roster, known = _squads(spark)
    found, plain = L.scenario_stats(roster, known, top_n), _plain(roster, known, top_n)
    assert set(found.columns) == set(plain.columns)
    names = sorted(found.columns)

    def rows(df):
        return sorted((tuple(r) for r in rounded(df, 4, nudge=True).select(*names).distinct().collect()), key=repr)

    assert rows(found) == rows(plain)


def test_equal_players_are_interchangeable(spark):
    roster, known = _squads(spark)
    per_team = {r.team_id: r["count"] for r in L.scenario_stats(roster, known).groupBy("team_id").count().collect()}
    # team 2: none, one, two or three of the equal ones, where all subsets are 16; team 4: the empty line-up has no players
    assert per_team == {1: 8, 2: 4, 3: 3, 4: 3, 5: 1}


def test_no_rows(spark):
    roster, known = _squads(spark)
    assert L.scenario_stats(roster.where("false"), known).count() == 0
    assert L.scenario_stats(roster, known.where("false")).count() == 0
    assert L.scenario_ids(roster.where("false")).count() == 0


def test_scenario_ids(spark):
    roster, _ = _squads(spark)
    ids = {}
    for r in L.scenario_ids(roster).collect():
        ids.setdefault(r.team_id, []).append(r.scenario_id)
    assert {t: sorted(v) for t, v in ids.items()} == {1: list(range(8)), 2: list(range(16)), 3: list(range(4)), 4: list(range(4)), 5: [0]}


def test_ten_times_the_players_are_ten_times_the_scenarios(spark, tmp_path):
    """10,000 players: ten leagues, whose teams have about four doubtful players each, as one league of 1,000 has."""
    spark.range(10_000).select(
        F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"),
        (F.xxhash64("id") % 25 + 25).cast("int").alias("k")).select("s_suppkey", "s_name", (F.col("k") % 25).alias("s_nationkey")).write.parquet(
        f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    sql = f"select team_id, count(distinct scenario_id) s, count(*) n, sum(player_id * (scenario_id + 1))::bigint h from ({ORACLES['r01_roster_scenarios']}) x group by 1"
    mine = QUERIES["r01_roster_scenarios"](spark, str(tmp_path)).groupBy("team_id").agg(
        F.count_distinct("scenario_id"), F.count("*"), F.sum(F.col("player_id") * (F.col("scenario_id") + 1)))
    theirs = con.execute(sql).fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(theirs)
    assert len(theirs) == 250 and max(r[1] for r in theirs) <= 2 ** 14
    ids = L.scenario_ids(fx.roster(spark, str(tmp_path)))
    assert ids.count() == sum(r[1] for r in theirs)
