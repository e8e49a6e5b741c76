"""The training frame: one row per played game with every pre-game feature of both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.select import matching, numeric_columns
from tipoff.operators import form, lineup, ratings, records, schedule, views
from tipoff.session import written

GAME_KEYS = ["game_id", "date", "season_id", "home_team", "guest_team"]
LABEL = "is_home_win"
# known only after the game, or not a feature at all
NOT_FEATURES = {*GAME_KEYS, LABEL, "is_clutch_game", "arena"}

# The model inputs that the shipped feature list names.
SELECTED_FEATURES = [
    "is_b2b_guest", "net_rtg_109_std_home", "off_rtg_ewm_vs_avg_home", "fg_opponent_ewm_vs_avg_home",
    "ast_to_tov_7_guest", "ts_diff_7_guest", "fg_pct_109_std_guest", "exp_fg_home", "exp_def_rtg_home",
    "exp_pts_guest", "exp_def_rtg_guest", "exp_fg_pct_guest", "players_pm109_gte_10_guest",
    "minutes_concentration_guest", "high_volatility_player_pct_guest", "elo_change_7_relative_home",
]

TEAM_OWN = [c for c in form.TEAM_STATS if not c.endswith("_opponent")
            and c not in ("pace", "tov_diff", "poss_diff", "net_rtg")]


def schedule_features(games: DataFrame) -> DataFrame:
    """Records, head-to-head, travel, rest and clutch results at game grain.

    Every part ends partitioned by ``game_id``, so the joins add no shuffle of their own. Every part has a row for each game, so none is broadcast here.
    """
    drop = [c for c in GAME_KEYS if c != "game_id"] + [LABEL]
    parts = [records.location_record(games), records.head_to_head(games), schedule.travel(games),
             schedule.rest(games), schedule.clutch(games)]
    base = records.overall_record(games).join(games.select("game_id", "is_playoff_game").hint("merge"), "game_id")
    return reduce(lambda a, b: a.join(b.drop(*drop).hint("merge"), "game_id"), parts, base)


def team_block(games: DataFrame, impute: bool = True, columns: list[str] | None = None, finish: lineup.Finish | None = None) -> DataFrame:
    rows = views.derived_box(views.team_boxscores(games, TEAM_OWN))
    return form.team_form(rows, impute=impute, also=("side",), columns=columns, finish=finish).drop("date", "season_id", "is_win")


def elo_block(rated: DataFrame) -> DataFrame:
    changed = ratings.elo_change(rated)
    return changed.select("game_id", F.col("team_id").alias("team"), F.col("elo_before").alias("elo"),
                          "elo_change_7_absolute", "elo_change_7_relative")


def training_frame(games: DataFrame, player_box: DataFrame | None, rated: DataFrame, impute: bool = True,
                   top_n: int = 10, columns: list[str] | None = None, finish: lineup.Finish | None = None) -> DataFrame:
    """All blocks, each row with its side, joined on ``game_id`` alone: the frame is shuffled once. Seasons are computed together; every window has the season in its key.

    The blocks are written once each, as both roles read them. ``columns`` names the features that the caller reads: the blocks of team form then
    hold no others, as Spark's column pruning does not reach into the arithmetic on Arrow batches. ``finish`` is applied to the values of team form, in
    the tasks that make them. The narrow blocks are attached first, so that the wide rows go through two joins alone.
    """
    played = written(games.where(F.col("pts_home").isNotNull() & F.col("pts_guest").isNotNull()), "played")
    frame = schedule_features(played)
    teams = None if columns is None else [c.rsplit("_", 1)[0] for c in columns]
    formed, sides = written(team_block(played, impute, teams, finish), "team-form"), []
    if player_box is not None:
        players = form.player_form(written(player_box, "player-box"), impute=impute, columns=lineup.FORM_COLUMNS)
        expected = lineup.expected_team_stats(players, top_n, dealt_by="game_id")
        if columns is not None:
            expected = expected.select(*[c for c in expected.columns if c in lineup.GAME_TEAM or c in teams])
        sides.append((written(views.with_side(expected, played, "team_id"), "expected"), "team_id"))
    sides.append((written(views.with_side(elo_block(rated), played), "elo"), "team"))
    order = [*frame.columns, *[f"{c}_{side}" for block, key in [(formed, "team"), *sides] for side in views.OTHER
                               for c in block.columns if c not in ("game_id", "side", key)]]
    for block, key in [*sides, (formed, "team")]:
        frame = views.attach_sides(frame, block, key)
    return frame.select(*order)


def feature_columns(frame: DataFrame, drop_previous: bool = True) -> list[str]:
    """Usable model inputs: numeric or boolean, and nothing that is known only afterwards."""
    allowed = set(numeric_columns(frame)) | {f.name for f in frame.schema.fields if f.dataType.simpleString() == "boolean"}
    previous = set(matching(frame, "previous")) | set(matching(frame, "b2b")) if drop_previous else set()
    return [c for c in frame.columns if c in allowed and c not in NOT_FEATURES and c not in previous]
