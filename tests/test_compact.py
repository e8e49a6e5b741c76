"""Doubles that go through a shuffle as two-byte whole numbers come back as they were."""

import datetime
import math
import random

import numpy as np

from tipoff.operators.form import PLAYER_STATS, player_form
from tipoff.operators.kernels import Packed

ODD = [None, float("nan"), float("inf"), -float("inf"), 0.0, 1.0, -1.0, 0.5, -2.25, 32766.0, 32767.0, 32768.0, -32766.0, -32767.0, -32768.0, -32769.0,
       65536.0, 1e300, -1e-300, 12345.000001]


def same(a, b) -> bool:
    return math.isnan(b) if a is None or math.isnan(a) else a == b


def test_any_value_comes_back(spark):
    rng = random.Random(1)
    rows = [(k, *[rng.choice(ODD) for _ in range(4)]) for k in range(300)] + [(300 + k, v, v, v, v) for k, v in enumerate(ODD)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    packed = Packed(df, ["a", "b", "c", "d"])
    shrunk = packed.shrink(df)
    assert shrunk.columns == ["k", "__small", "__exact"]
    for some in (shrunk, shrunk.where("k < 0")):
        sent = packed.pack(some.repartition(3, "k")).toArrow().to_batches()
        found = {k: values for batch in sent for k, *values in zip(*(c.to_pylist() for c in packed.unpack(batch).columns))}
        assert len(found) == (len(rows) if some is shrunk else 0)
        assert all(same(a, b) for k, *values in rows if found for a, b in zip(values, found[k]))


def test_form_of_players_is_shuffled_as_whole_numbers(spark):
    rng = random.Random(2)
    rows = [(g, datetime.date(2001, 1, 1) + datetime.timedelta(days=g), 2001, p, 1, *[rng.choice([None, float(rng.randint(0, 40)), rng.random()]) for _ in PLAYER_STATS])
            for p in range(3) for g in range(12)]
    box = spark.createDataFrame(rows, "game_id long, date date, season_id int, player_id long, team_id int, " + ", ".join(f"{c} double" for c in PLAYER_STATS))
    form = player_form(box)
    assert "__small" in form._jdf.queryExecution().executedPlan().toString()
    found = {(r.player_id, r.game_id): r for r in form.collect()}
    of = {(r[3], r[0]): dict(zip(PLAYER_STATS, r[5:])) for r in rows}
    for (p, g), r in found.items():
        for c in PLAYER_STATS:
            assert r[f"{c}_previous_game"] == (of[p, g - 1][c] if g else None)
            known = [of[p, k][c] for k in range(max(g - 7, 0), g) if of[p, k][c] is not None]
            assert (r[f"{c}_7"] is None) if not known else np.isclose(r[f"{c}_7"], sum(known) / len(known), rtol=1e-12, atol=1e-12)
    assert len(found) == 36
