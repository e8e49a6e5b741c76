"""Places and running sums over the whole table equal plain windows, and one hot date does not stay in one task."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tipoff.ml import metrics, split
from tipoff.operators.ordered import RANGE, cumulative, numbered, ranged
from tipoff.operators.relational import as_of


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 games, nine in ten on one date; some dates, keys and outcomes are NULL and some rows repeat."""
    rng = random.Random(5)
    rows = []
    for game in range(3000):
        day = datetime.date(2001, 5, 5) if rng.random() < 0.9 else datetime.date(2001, 1, 1) + datetime.timedelta(days=rng.randrange(300))
        rows.append((None if game % 97 == 0 else day, game if game % 50 else 7, rng.choice(["a", "a", "a", None, "b"]), rng.random() < 0.4,
                     0.5 + rng.randrange(40) * 1e-6))
    return spark.createDataFrame(rows, "date date, game_id long, team string, is_win boolean, proba double")


def in_order(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_places_equal_a_window(hot):
    columns = ("date", "game_id", "ordinal", "entity_rows")
    plain = hot.select("date", "game_id", (F.row_number().over(Window.orderBy("date", "game_id")) - 1).alias("ordinal"),
                       F.count(F.lit(1)).over(Window.partitionBy()).alias("entity_rows"))
    assert in_order(numbered(hot, ("date", "game_id")), *columns) == in_order(plain, *columns)


def test_places_in_groups_equal_a_window(hot):
    columns = ("team", "date", "game_id", "ordinal", "entity_rows")
    own = Window.partitionBy("team")
    plain = hot.select("team", "date", "game_id", (F.row_number().over(own.orderBy("date", "game_id")) - 1).alias("ordinal"),
                       F.count(F.lit(1)).over(own).alias("entity_rows"))
    assert in_order(numbered(hot, ("date", "game_id"), by=("team",)), *columns) == in_order(plain, *columns)


def test_sums_equal_a_window(hot):
    unique = hot.where("game_id <> 7")
    own = Window.partitionBy("team")
    before = own.orderBy("date", "game_id").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("is_win").cast("long")
    plain = unique.select("game_id", F.coalesce(F.sum(won).over(before), F.lit(0)).alias("w"), F.sum(won).over(own).alias("n"))
    mine = cumulative(unique, ("date", "game_id"), {"w": won}, {"n": won}, by=("team",))
    assert in_order(mine, "game_id", "w", "n") == in_order(plain, "game_id", "w", "n")


@pytest.mark.parametrize("order", [("date", "game_id"), ("date",)])
def test_a_hot_date_is_spread(spark, hot, order):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = [r["count"] for r in ranged(hot, order).groupBy(RANGE).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(sizes) >= 12 and max(sizes) < 3 * 3000 / 16


def test_close_probabilities_give_the_exact_area(hot):
    rows = [(r.is_win, r.proba) for r in hot.collect()]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    exact = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(hot, "is_win", "proba").first()[0] - exact) < 1e-12


def test_empty_tables(spark, hot):
    none = hot.where("false")
    assert numbered(none, ("date", "game_id")).count() == 0
    assert numbered(none, ("date", "game_id"), by=("team",)).count() == 0
    assert cumulative(none, ("date",), {"w": F.lit(1)}).count() == 0
    assert split.expanding_folds(none.select("date", "game_id")).count() == 0
    assert metrics.roc_auc(none, "is_win", "proba").first()[0] is None


@pytest.mark.parametrize("same_instant", [True, False])
def test_as_of_sees_the_latest_earlier_row(spark, same_instant):
    """Entity 1 has nine rows in ten; keys and instants may be NULL, and several rows may share an instant."""
    rng = random.Random(9)
    draw = lambda: (1 if rng.random() < 0.9 else rng.choice([2, 3, None]), None if rng.random() < 0.05 else rng.randrange(400))
    left = [(k, *draw(), "x") for k in range(800)]
    right = [(*draw(), k, None if k % 11 == 0 else k * 0.5) for k in range(500)]

    def expected(key, at):
        known = [(t, n, v) for e, t, n, v in right if e == key and t is not None and at is not None and key is not None
                 and (t <= at if same_instant else t < at)]
        return max(known, key=lambda r: r[:2])[1:] if known else (None, None)

    out = as_of(spark.createDataFrame(left, "row long, entity int, at long, pts string"), spark.createDataFrame(right, "entity int, at long, n long, value double"),
                ["entity"], "at", ["n", "value"], ("n",), same_instant)
    assert out.columns == ["row", "entity", "at", "pts", "n", "value"]
    assert sorted((r.row, r.n, r.value) for r in out.collect()) == sorted((k, *expected(e, t)) for k, e, t, _ in left)
    assert as_of(spark.createDataFrame(left, "row long, entity int, at long, pts string"), spark.createDataFrame([], "entity int, at long, n long"),
                 ["entity"], "at", ["n"]).where("n is null").count() == len(left)
