"""Schedule effects: travel, rest, game density and results in close games."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalar import haversine_km
from tipoff.operators.form import Form, placed
from tipoff.operators.ordered import TEAM_SEASON, UNBOUNDED, Timeline, running
from tipoff.operators.views import team_rows, to_game_grain

CLUTCH_MARGIN = 5


def travel(games: DataFrame, line: Timeline = TEAM_SEASON) -> DataFrame:
    """Kilometres to reach each game: since the last game, in the last 7 days and in the season so far.

    A leg belongs to the game it leads to; the first game has none. Day -7 counts. Other games of the same
    date count only if they come earlier in the order.
    """
    rows = team_rows(games, ["game_id", "date", "season_id", "home_team", "guest_team", "latitude", "longitude"])
    here = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    rows = running(rows, line, lasts={"__from": here})
    leg = haversine_km("__from.lat", "__from.lon", "latitude", "longitude")
    rows = rows.select("*", F.coalesce(leg, F.lit(0.0)).alias("leg")).drop("__from")

    # legs of the day up to this game, plus whole earlier days: never a scan of the entity's rows
    today = Window.partitionBy(*line.keys, "date").orderBy("game_id").rowsBetween(UNBOUNDED, 0)
    rows = rows.select("*", F.sum("leg").over(today).alias("__today"))
    days = rows.groupBy(*line.keys, "date").agg(F.sum("leg").alias("__km")).select(
        "*", F.unix_date("date").alias("__day"))
    by_day = Window.partitionBy(*line.keys).orderBy("__day")
    days = days.select(
        *line.keys, "date",
        F.coalesce(F.sum("__km").over(by_day.rangeBetween(-7, -1)), F.lit(0.0)).alias("__week"),
        F.coalesce(F.sum("__km").over(by_day.rowsBetween(UNBOUNDED, -1)), F.lit(0.0)).alias("__season"))
    rows = rows.hint("merge").join(days, [*line.keys, "date"]).select(
        *[c for c in rows.columns if c not in ("leg", "__today")],
        F.round("leg", 2).alias("km_since_last_game"),
        F.round(F.col("__week") + F.col("__today"), 2).alias("km_last_7_days"),
        F.round(F.col("__season") + F.col("__today"), 2).alias("km_season_total"))
    return to_game_grain(rows, ["game_id", "date", "season_id", "home_team", "guest_team"], {
        c: "{side}_" + c for c in ("km_since_last_game", "km_last_7_days", "km_season_total")})


def team_dates(games: DataFrame) -> DataFrame:
    """Distinct playing dates of every team."""
    return team_rows(games, ["date", "season_id"]).select("season_id", "team", "date").distinct()


def rest_by_date(games: DataFrame) -> DataFrame:
    """Days since the previous playing date and playing dates in the 3 and 5 days before, per team and date."""
    dates = team_dates(games).select("*", F.unix_date("date").alias("__day"))
    w = Window.partitionBy("season_id", "team").orderBy("__day")
    one = F.lit(1)
    return dates.select(
        "season_id", "team", "date",
        F.datediff("date", F.lag("date", 1).over(w)).cast("bigint").alias("days_rest"),
        F.count(one).over(w.rangeBetween(-3, -1)).alias("games_last_3_density"),
        F.count(one).over(w.rangeBetween(-5, -1)).alias("games_last_5_density"))


def rest(games: DataFrame) -> DataFrame:
    """Rest and density of both teams; back-to-back means exactly one day since the last playing date."""
    rows = team_rows(games, ["game_id", "date", "season_id", "home_team", "guest_team"])
    rows = rows.hint("merge").join(rest_by_date(games), ["season_id", "team", "date"]).select(
        "*", (F.col("days_rest") == 1).alias("is_b2b"))
    return to_game_grain(rows, ["game_id", "date", "season_id", "home_team", "guest_team"], {
        "days_rest": "{side}_days_rest", "games_last_3_density": "{side}_games_last_3_density",
        "games_last_5_density": "{side}_games_last_5_density", "is_b2b": "is_b2b_{side}"})


def is_clutch(home: str = "pts_home", guest: str = "pts_guest"):
    margin = F.abs(F.col(home) - F.col(guest))
    return (margin <= CLUTCH_MARGIN) & (margin > 0)


def clutch(games: DataFrame, window: int = 109, line: Timeline = TEAM_SEASON, size: int | None = None) -> DataFrame:
    """Share of close games won among the last ``window`` close games, as known before each game."""
    flagged = games.select("*", is_clutch().alias("is_clutch_game"))
    carry = ["game_id", "date", "season_id", "home_team", "guest_team", "is_clutch_game"]
    rows = team_rows(flagged, carry)
    close = rows.where("is_clutch_game").select(
        "game_id", "date", *line.keys, F.col("win").cast("bigint").alias("won"))
    share = Form(placed(close, line, [window], size=size), line).rolling(
        ["won"], [window], lambda c, w: 1, mean="__share", std=None, include_current=True)
    share = share.done(["game_id", "team", "__share"])
    rows = rows.join(share, ["game_id", "team"], "left")
    rows = running(rows, line, lasts={"clutch_win_pct": F.col("__share")})
    return to_game_grain(rows, carry, {"clutch_win_pct": "clutch_win_pct_{side}"})


def forward_filled(df: DataFrame, line: Timeline, column: str) -> DataFrame:
    """The column's latest non-NULL value up to and including the row."""
    rows = running(df, line, lasts={"__earlier": F.col(column)})
    return rows.withColumn(column, F.coalesce(F.col(column), F.col("__earlier"))).drop("__earlier")
