"""Run store, simplex weights and stat tables."""

import math
import random

import pytest

from tipoff.ml import combine
from tipoff.ml.store import RunStore
from tipoff.session import new_path
from tipoff.sources import landed


def test_two_saves_give_the_newest_once(spark):
    store = RunStore(spark, new_path(spark, "runs"), "a")
    store.save_settings("config", {"threshold": 0.4})
    store.save_settings("config", {"threshold": 0.6})
    store.save_settings("other", {"x": 1})
    RunStore(spark, store.root, "b").save_settings("config", {"threshold": 0.9})
    assert store.settings().count() == 2 and store.setting("config") == {"threshold": 0.6}
    with pytest.raises(KeyError):
        store.setting("none")
    for loss in (0.5, 0.4):
        store.save_history(spark.createDataFrame([(loss,)], "loss double"))
    assert sorted(r.loss for r in store.history().collect()) == [0.4, 0.5] and store.history().select("version").distinct().count() == 2


def test_weights_are_at_least_as_good_as_any_drawn(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(800):
        p = rng.random()
        won = rng.random() < p
        rows.append((won, min(0.999, max(0.001, p + rng.gauss(0, 0.1))), rng.random(), min(0.99, max(0.01, p + rng.gauss(0, 0.25)))))
    rows += [(None, 0.5, 0.5, 0.5), (True, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "won boolean, a double, b double, c double")
    columns = ["a", "b", "c"]
    weights = combine.fit_weights(df, "won", columns)
    assert math.isclose(sum(weights), 1, abs_tol=1e-9) and min(weights) >= 0

    def loss(w):
        return sum(-math.log(sum(x * (p if won else 1 - p) for x, p in zip(w, ps))) for won, *ps in rows[:800]) / 800

    drawn, _ = combine.search_weights(df.where("a is not null"), "won", columns, "log_loss", n=200)
    assert loss(weights) <= loss(drawn) + 1e-7
    assert combine.fit_weights(df.where("false"), "won", columns) == [1 / 3] * 3


def test_stat_rows_need_no_shuffle(spark):
    head = '<thead><tr><th>x</th></tr><tr><th data-stat="player">p</th><th data-stat="mp">mp</th><th data-stat="pts">pts</th></tr></thead>'
    body = ('<tr><th data-append-csv="ann">Ann</th><td>12:30</td><td> 7 </td></tr><tr class="thead"><th>Reserves</th></tr>'
            '<tr><th data-append-csv="bob">Bob</th><td>Did not play</td></tr>')
    page = f'<table class="y" id="t">{head}<tbody>{body}</tbody><tfoot><tr><th>All</th><td>240</td><td>99</td></tr></tfoot></table>'
    pages = spark.createDataFrame([(1, page), (2, "<p>no table</p>"), (3, None)], "page_id long, html string")
    wide = landed.wide_stats(landed.table_rows(pages, "t"), "tbody", ["mp", "pts", "fg"])
    assert [tuple(r)[2:] for r in wide.orderBy("row").collect()] == [("ann", "Ann", "12:30", "7", None), ("bob", "Bob", "Did not play", None, None)]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    cells = {(r.section, r.row_id, r.stat): r.text for r in landed.stat_table(pages, "t").collect()}
    assert cells[("tbody", "ann", "pts")] == "7" and cells[("tfoot", "", "mp")] == "240" and len(cells) == 5
