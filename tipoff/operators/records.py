"""Win-loss records as they stood before each game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.scalar import composite_key, ratio
from tipoff.operators.ordered import TEAM_SEASON, running
from tipoff.operators.views import team_rows, to_game_grain

GAME_COLUMNS = ["game_id", "date", "season_id", "home_team", "guest_team", "is_home_win"]


def _won() -> Column:
    return F.col("win").cast("bigint")


def _lost() -> Column:
    return (~F.col("win")).cast("bigint")


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _results(games: DataFrame) -> DataFrame:
    return team_rows(games, GAME_COLUMNS)


def overall_record(games: DataFrame) -> DataFrame:
    """Season wins, games and win percentage of both teams before the game."""
    rows = running(_results(games), TEAM_SEASON, sums={"wins": _won(), "played": _one()})
    rows = rows.select("*", ratio("wins", "played").alias("pct"))
    return to_game_grain(rows, GAME_COLUMNS, {
        "played": "games_this_year_{side}_team", "wins": "wins_this_year_{side}_team", "pct": "win_pct_{side}"})


def location_record(games: DataFrame) -> DataFrame:
    """The host's record at home and the guest's record away, before the game."""
    line = TEAM_SEASON.by("season_id", "team", "side")
    rows = running(_results(games), line, sums={"wins": _won(), "played": _one()})
    rows = rows.select("*", ratio("wins", "played").alias("pct"))
    return to_game_grain(rows, GAME_COLUMNS, {
        "played": {"home": "home_games_this_year_home_team", "guest": "away_games_this_year_guest_team"},
        "wins": {"home": "home_wins_this_year_home_team", "guest": "away_wins_this_year_guest_team"},
        "pct": {"home": "home_win_pct_home", "guest": "away_win_pct_guest"}})


def head_to_head(games: DataFrame) -> DataFrame:
    """Season meetings of the two teams at either venue before the game, as the current host sees them."""
    line = TEAM_SEASON.by("season_id", "team", "opponent")
    rows = running(_results(games), line,
                   sums={"h2h_wins_home": _won(), "h2h_wins_guest": _lost(), "h2h_games": _one()})
    return rows.where(F.col("side") == "home").select(
        *GAME_COLUMNS, "h2h_wins_home", "h2h_wins_guest", "h2h_games",
        ratio("h2h_wins_home", "h2h_games").alias("h2h_win_pct"))


def team_records(games: DataFrame) -> DataFrame:
    """One row per (game, team) with wins and losses before the game and a composite id.

    Games of a season whose team has neither a result nor a record yet are left out.
    """
    rows = running(_results(games), TEAM_SEASON, sums={"wins_before": _won(), "losses_before": _lost()})
    blank = F.col("win").isNull() & (F.col("wins_before") == 0) & (F.col("losses_before") == 0)
    return rows.where(~blank).select(
        composite_key("game_id", "team").alias("id"), "game_id", "season_id", "team", "wins_before", "losses_before")
