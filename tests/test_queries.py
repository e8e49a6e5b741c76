"""The registry, a few oracles end to end, and stream = batch."""

import math

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["w02_location_win_pct", "w08_blowouts", "w13_travel", "w16_clutch", "j06_upcoming_games",
                                  "r01_roster_scenarios", "m03_expanding_folds", "m20_roc_auc", "s10_upsert"])
def test_oracle(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) == ""


def test_elo_stream_equals_batch(spark, sf_dir):
    batch = {(r.game_id, r.team_id): r.elo_after for r in entry.queries()["e02_elo_carry_over"](spark, sf_dir).collect()}
    stream = {(r.game_id, r.team_id): r.elo_after for r in entry.queries()["st01_elo_stream"](spark, sf_dir).collect()}
    assert batch.keys() == stream.keys()
    assert all(math.isclose(batch[k], stream[k], abs_tol=2e-6) for k in batch)
