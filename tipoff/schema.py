"""Declared schemas of the landed tables (nothing is inferred from data)."""

from __future__ import annotations

from pyspark.sql import types as T

COUNTING = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts"]
PERCENT = ["fg_pct", "fg3_pct", "ft_pct"]
TEAM_RATES = ["tov_pct", "off_rtg", "def_rtg"]
PLAYER_RATES = [
    "ts_pct", "efg_pct", "fg3a_per_fga_pct", "fta_per_fga_pct", "orb_pct", "drb_pct", "trb_pct",
    "ast_pct", "stl_pct", "blk_pct", "tov_pct", "usg_pct",
]


def _fields(pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


SCHEDULE = _fields(
    [("game_id", T.StringType()), ("date", T.DateType()), ("season_id", T.IntegerType())]
    + [(c, T.StringType()) for c in ("home_team", "guest_team", "home_abbrev", "guest_abbrev", "arena", "game_url")]
    + [("is_scraped", T.BooleanType())]
)

BOXSCORE = _fields(
    [("game_id", T.StringType())]
    + [(f"{c}_{side}", T.DoubleType())
       for side in ("home", "guest") for c in COUNTING + PERCENT + ["mp"] + TEAM_RATES]
)

PLAYER_BOXSCORE = _fields(
    [(c, T.StringType()) for c in ("game_id", "player_id", "team_id")]
    + [(c, T.DoubleType())
       for c in ["mp"] + COUNTING + PERCENT + ["game_score", "plus_minus"] + PLAYER_RATES + ["off_rtg", "def_rtg", "bpm"]]
)

ELO = _fields([("id", T.StringType()), ("game_id", T.StringType()), ("team_id", T.StringType()),
               ("elo_before", T.DoubleType()), ("elo_after", T.DoubleType())])

PLAYOFFS = _fields([("season_id", T.IntegerType()), ("playoff_start", T.DateType())])
LOCATION = _fields([("arena", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType())])
TEAM_RECORD = _fields([("id", T.StringType()), ("game_id", T.StringType()), ("season_id", T.IntegerType()),
                       ("team", T.StringType()), ("wins_before", T.LongType()), ("losses_before", T.LongType())])
ROSTER = _fields([(c, T.StringType()) for c in ("player_name", "player_id", "injury", "team_id")])


def predictions(models: list[str]) -> T.StructType:
    return _fields(
        [("game_id", T.StringType()), ("is_home_win", T.BooleanType())]
        + [(f"proba_{m}", T.DoubleType()) for m in models]
        + [(f"is_predicted_home_win_{m}", T.BooleanType()) for m in models]
    )
