"""Line-up stats on Arrow batches, the features and columns that a query needs and no others, and regular expressions that are read once."""

import datetime
import decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tipoff.operators import form, lineup
from tipoff.operators.kernels import Packed
from tipoff.queries import base, windows
from tipoff.sources import landed

KEYS = ["game_id", "team_id"]


@pytest.fixture
def box(spark):
    """Fourteen players of two teams in games on 30 days; some values and one player's id are NULL, and many minutes are equal."""
    start, out = datetime.date(2020, 1, 1), []
    for player in [*range(1, 14), None]:
        for day in range(player or 3, 30, 1 + (player or 1) % 2):
            number = player or 20
            out.append((day, start + datetime.timedelta(days=day), 2020, player, number % 5 // 4, float(number % 3 * 8),
                        *[float((day * 7 + j * number) % 11 - 3) if (day + j + number) % 6 else None for j in range(1, len(form.PLAYER_STATS))]))
    schema = "game_id long, date date, season_id int, player_id long, team_id int, " + ", ".join(f"{c} double" for c in form.PLAYER_STATS)
    return spark.createDataFrame(out, schema)


def _values(df, columns):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("top_n", [2, 10])
def test_arrays_and_columns_give_the_same_stats(box, top_n):
    players = form.player_form(box, columns=lineup.FORM_COLUMNS).localCheckpoint()
    by_columns = lineup.expected_team_stats(players, top_n, dealt_by="game_id")
    wanted = _values(by_columns, by_columns.columns)
    found = lineup.team_stats(players, top_n)
    assert found.dtypes == by_columns.dtypes and _values(found, found.columns) == wanted and len(wanted) > 40
    assert _values(lineup.form_stats(box, top_n), by_columns.columns) == wanted


@pytest.mark.parametrize("names", [["avg_pts_volatility"], ["top3_minutes_share"], ["exp_fg_pct", "bench_avg_plus_minus"], ["team_consistency_score"]])
def test_some_stats_need_their_features_alone(box, names):
    columns = lineup.form_columns(names)
    assert set(columns) < set(lineup.FORM_COLUMNS)
    slim = box.select(*form.PLAYER_KEYS, *form.stats_of(columns))
    assert len(slim.columns) < 10
    found = lineup.form_stats(slim, names=names)
    assert found.columns == [*KEYS, *names]
    assert _values(found, found.columns) == _values(lineup.form_stats(box), found.columns)


def test_box_scores_hold_the_stats_that_are_read(spark, sf_dir):
    assert set(windows.player_box_of(spark, sf_dir, windows.MINUTES).columns) == {*form.PLAYER_KEYS, "mp"}


def test_packed_rows_come_back_whole(spark):
    schema = "a long, b int, c date, d boolean, e double, f string, g double, h smallint, i tinyint, j float, k decimal(5,2)"
    rows = [(2**53 + 1, -5, datetime.date(1969, 12, 30), True, 1.5, "x", None, 7, -1, 0.5, None), (None,) * 11,
            (-2**63, 2**31 - 1, datetime.date(9999, 12, 31), False, float("inf"), "", -0.0, None, 127, None, decimal.Decimal("3.00"))]
    df = spark.createDataFrame(rows, schema)
    packed = Packed(df)
    sent = packed.pack(df)
    assert sent.columns == ["f", "j", "k", "__wholes", "__doubles"]
    for some in (df, df.where("false")):
        got = some.sparkSession.createDataFrame(packed.pack(some).mapInArrow(lambda batches: map(packed.unpack, batches), df.schema).toArrow(), df.schema)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, some.collect()))
    assert packed.unpack(pa.RecordBatch.from_pylist([], sent.limit(0).toArrow().schema)).num_rows == 0


@pytest.mark.parametrize("name", ["w19_top_players", "a04_form_change", "a08_bench_strength"])
def test_rows_go_to_python_in_two_columns(spark, sf_dir, name):
    """Spark's Arrow writer takes a time for each row that grows with the columns; no key that nothing reads comes back."""
    found = base.QUERIES[name](spark, sf_dir)
    lines = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert lines and all("MapInArrow walk(__wholes#" in line and line.partition(")")[0].count("#") == 2 for line in lines)
    assert "season_id" not in lines[-1].partition(")")[2]


@pytest.mark.parametrize("size", [100, 8])
def test_latest_rows(box, size):
    options = {"size": size, "columns": ["pts_7", "mp_3"], "windows": (3, 7)}
    of_all, of_last = (form.player_form(box, latest=latest, **options) for latest in (False, True))
    assert of_last.count() < of_all.count() / 3

    def newest(df):
        return df.groupBy("player_id").agg(F.max_by(F.struct("game_id", "pts_7", "mp_3"), F.struct("date", "game_id")).alias("l")).select("player_id", "l.*")

    assert _values(newest(of_last), ["player_id", "game_id", "pts_7", "mp_3"]) == _values(newest(of_all), ["player_id", "game_id", "pts_7", "mp_3"])


def test_quick_rounding_is_spark_rounding(spark, monkeypatch):
    monkeypatch.setattr(base, "CHECKING", True)
    numbers = [0.0, -0.0, 0.5, 1.0000005, 2.0000015, -1.0000005, 0.1234565, 1234.565, -1234.565, 999.9999999, 1e-9, -1e-9, 1e12 + 0.5, 1e300,
               float("nan"), float("inf"), float("-inf"), 0.3, 1 / 3, 2 / 3, *[k / 2e6 + 1e-17 for k in range(-50, 50)]]
    rows = spark.createDataFrame([(v,) for v in [*numbers, None]], "v double")

    def plain(v):
        value = F.col(v) * base.NUDGE
        return F.when(F.abs(value) >= base.LARGE, F.round(value, 2)).otherwise(F.round(value, 6))

    wanted = [repr(r[0]) for r in rows.select(plain("v")).collect()]
    assert [repr(r[0]) for r in base.rounded(rows, nudge=True).collect()] == wanted
    assert [repr(r[0]) for r in base.rounded(rows).collect()] == [repr(r[0]) for r in rows.select(F.round("v", 6)).collect()]
    assert [repr(float(v)) for v in base.nudged()(np.array(numbers))] == wanted[:-1]


def test_cells_of_a_row_are_read_once(spark):
    page = ('<table id="t"><thead><tr><th>x</th></tr><tr><th data-stat="player">p</th><th data-stat="mp">m</th><th data-stat="pts">p</th></tr></thead>'
            '<tbody><tr><th data-append-csv="a1">A</th><td>10:30</td><td> <b>7</b></td></tr><tr><th>Reserves</th></tr></tbody></table>')
    pages = spark.createDataFrame([(1, page), (2, "<p>no table</p>"), (3, None)], "page_id long, html string")
    rows = landed.typed_players(landed.wide_stats(landed.table_rows(pages, "t"), "tbody", ["mp", "pts"]), ["mp", "pts"])
    assert [tuple(r) for r in rows.collect()] == [(1, "a1", "A", 10.5, 7.0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<td[^>]*>") == 1 and plan.count("<thead[^>]*>") == 1 and plan.count("<table[^>]*id=") == 1
