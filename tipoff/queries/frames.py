"""F01 training frame, R03 upcoming frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.operators import ratings
from tipoff.plans import training, upcoming
from tipoff.queries.base import ORACLES, nudged, query, rounded, sql_round
from tipoff.queries.lineups import NAMES, _shown, exp_ctes
from tipoff.queries.rating import _CARRIED, league_games
from tipoff.queries.windows import _TF, sql_player_form, sql_team_form

# what SQL can rebuild of the selected features (ratings are sequential)
_SQL_SELECTED = [c for c in training.SELECTED_FEATURES if not c.startswith("elo_") and c != "is_b2b_guest"]


def full_frame(spark, sf_dir, columns=None, finish=None):
    rated = ratings.elo(league_games(spark, sf_dir))
    return training.training_frame(fx.season_games(spark, sf_dir), fx.player_box(spark, sf_dir), rated, columns=columns, finish=finish)


@query("f01_training_frame")
def f01(spark, sf_dir):
    """All blocks are joined; the shipped model's inputs are shown."""
    return rounded(full_frame(spark, sf_dir, training.SELECTED_FEATURES).select(
        "game_id", "date", "home_team", "guest_team", "is_home_win", *training.SELECTED_FEATURES))


def _role(column: str) -> str:
    name, side = column.rsplit("_", 1)
    alias = {"home": "home_", "guest": "guest_"}[side]
    table = "e" if name in NAMES else "t"
    return f"{alias}{table}.{name} as {column}" if table == "e" else sql_round(f"{alias}{table}.{name}", column, nudge=True)


@query("f01_selected_features", with_sql("games player_box team_games", f"""select g.game_id, g.date, g.home_team, g.guest_team, g.is_home_win,
    rd.days_rest = 1 as is_b2b_guest, {', '.join(_role(c) for c in _SQL_SELECTED)}
    from games g join tf home_t on home_t.game_id = g.game_id and home_t.team = g.home_team
    join tf guest_t on guest_t.game_id = g.game_id and guest_t.team = g.guest_team
    left join sx home_e on home_e.game_id = g.game_id and home_e.team_id = g.home_team
    left join sx guest_e on guest_e.game_id = g.game_id and guest_e.team_id = g.guest_team
    join dp rd on rd.season_id = g.season_id and rd.team = g.guest_team and rd.date = g.date
    where g.pts_home is not null""", {
    **sql_team_form(), **sql_player_form(),
    **{k: v.replace("place <= 2", "place <= 10") for k, v in exp_ctes().items()},
    "sx": f"select game_id, team_id, {_shown(NAMES)} from ex",
    "dq": "select distinct season_id, team, date from team_games where win is not null",
    "dp": "select *, date - lag(date) over (partition by season_id, team order by date) as days_rest from dq",
}))
def f01_selected(spark, sf_dir):
    wanted = ["is_b2b_guest", *_SQL_SELECTED]
    return rounded(full_frame(spark, sf_dir, wanted).select(
        "game_id", "date", "home_team", "guest_team", "is_home_win", *wanted), nudge=True)


_STREAKS = ["has_won_last_game", "current_winning_streak", "current_losing_streak"]
_ELO = ["elo", "elo_change_7_absolute", "elo_change_7_relative"]
_TEAM = frozenset(f"{c}_{side}" for c in _TF for side in ("home", "guest"))
_QUOTIENTS = frozenset(f"{c}_{side}" for c in NAMES for side in ("home", "guest"))


def _played(name: str) -> str:
    """The SQL of a single block, over played games only."""
    return ORACLES[name].replace("from sched s left join box b", "from sched s join box b")


def _whole_frame_sql() -> str:
    games = {k: f"({_played(name)})" for k, name in {
        "b1": "w01_overall_win_pct", "b2": "w02_location_win_pct", "b3": "w03_head_to_head", "b4": "w13_travel", "b5": "w14_rest_days",
        "b6": "w16_clutch"}.items()}
    expected = {**sql_player_form(), **{k: v.replace("place <= 2", "place <= 10") for k, v in exp_ctes().items()}}
    back = "lag(elo_before, 7) over (partition by league, team_id order by date, game_id)"
    ctes = {
        **games, "ph": f"({with_sql('season_games', 'select game_id, is_playoff_game from season_games')})", "tf": f"({_played('w11_team_form')})",
        "ex": f"({with_sql('player_box', f'select game_id, team_id, {_shown(NAMES)} from ex', expected)})",
        "el": f"""({_CARRIED} select game_id, team_id, {sql_round('elo_before', 'elo')}, {sql_round(f'elo_before - {back}', _ELO[1])},
            {sql_round(f'elo_before / {back} - 1', _ELO[2])} from rated)""",
    }
    keys, sides = "game_id, date, season_id, home_team, guest_team", []
    shown = ["b1.*", "is_playoff_game", *[f"{b}.* exclude ({keys}{', is_home_win' if b in ('b2', 'b3') else ''})" for b in list(games)[1:]]]
    for side in ("home", "guest"):
        for table, team, columns in (("tf", "team", [*_STREAKS, *_TF]), ("ex", "team_id", NAMES), ("el", "team_id", _ELO)):
            at = f"{table}_{side}"
            sides.append(f"left join {table} {at} on {at}.game_id = b1.game_id and {at}.{team} = b1.{side}_team")
            shown += [f"{at}.{c} as {c}_{side}" for c in columns]
    return (f"with {', '.join(f'{k} as {v}' for k, v in ctes.items())} select {', '.join(shown)} from b1 join ph on ph.game_id = b1.game_id "
            + " ".join(f"join {b} on {b}.game_id = b1.game_id" for b in list(games)[1:]) + " " + " ".join(sides))


@query("f01_whole_frame", _whole_frame_sql())
def f01_whole(spark, sf_dir):
    """Every column of every block. Team form, most of the columns, is rounded in the tasks that make it."""
    return rounded(full_frame(spark, sf_dir, finish=nudged()), nudge=_QUOTIENTS, done=_TEAM)


def coming_frame(spark, sf_dir):
    """Leagues are rated side by side. Their teams have different numbers, so the frame needs no league."""
    games = fx.season_games(spark, sf_dir, leagues=True)
    league = F.floor(F.col("home_team") / fx.LEAGUE_TEAMS).alias("league")
    rated = ratings.elo(fx.games(spark, sf_dir, leagues=True).select("*", league)).drop("league")
    return upcoming.upcoming_frame(games, fx.player_box(spark, sf_dir), rated, fx.roster(spark, sf_dir))


@query("r03_upcoming_frame")
def r03(spark, sf_dir):
    """Every column of every block, for each pair of scenarios."""
    return rounded(coming_frame(spark, sf_dir))
