"""Joins between the schedule, its results and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.operators.ordered import cumulative


def with_venue_and_phase(games: DataFrame, location: DataFrame, playoffs: DataFrame) -> DataFrame:
    """Star join to the venue and the season calendar; adds the playoff flag.

    The lookups carry no broadcast hint: Spark broadcasts them while their measured size allows it.
    """
    return games.join(location, "arena").join(playoffs, "season_id").select(
        *games.columns, "latitude", "longitude", (F.col("date") >= F.col("playoff_start")).alias("is_playoff_game"))


def remaining(schedule: DataFrame, boxscore: DataFrame) -> DataFrame:
    """Games without a box score."""
    return schedule.join(boxscore.select("game_id"), "game_id", "left_anti")


def upcoming_games(schedule: DataFrame, boxscore: DataFrame) -> DataFrame:
    """Remaining games that are the next remaining game of both of their teams."""
    todo = remaining(schedule, boxscore)
    sides = todo.select("game_id", "date", F.explode(F.array("home_team", "guest_team")).alias("team"))
    first = sides.groupBy("team").agg(F.min(F.struct("date", "game_id")).alias("next"))
    both = first.groupBy(F.col("next.game_id").alias("game_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return todo.join(both.select("game_id"), "game_id", "left_semi")


def latest_per(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each key's last row on a total order, found by partial aggregation (no sort, no hot task)."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], order: tuple[str, ...] = (), same_instant: bool = True) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the latest row of ``right`` with the same ``keys`` whose ``at`` is not later.

    Without ``same_instant`` it must be earlier. ``order`` decides between rows of ``right`` at one instant: the last one is seen. Both sides lie in one order
    of (keys, instant), dealt out by ranges; a range takes the last row of the ranges before it along. So a key with most of the rows is spread over many tasks. What has no
    earlier row, a NULL key or a NULL instant has NULL columns; instants of ``right`` that are NULL are never seen.
    """
    held = F.struct(*[F.col(c).alias(f"r{k}") for k, c in enumerate(columns)])
    seen = right.where(F.col(at).isNotNull()).select(
        *keys, F.col(at), F.lit(0 if same_instant else 1).alias("__side"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)],
        held.alias("__held"))
    asking = left.select(*keys, F.col(at), F.lit(1 if same_instant else 0).alias("__side"), F.struct("*").alias("__row"))
    both = asking.unionByName(seen, allowMissingColumns=True)
    found = cumulative(both, (at, "__side", *[f"__o{k}" for k in range(len(order))]), lasts={"__seen": F.col("__held")}, by=tuple(keys))
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return found.where("__row is not null").select("__row.*", *[F.when(known, F.col(f"__seen.r{k}")).alias(c) for k, c in enumerate(columns)])


def keyed_on_values(basic: DataFrame, advanced: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on a natural key that may hold NULLs; a NULL key never matches."""
    return basic.join(advanced, keys)


def require_rows(joined: DataFrame, expected: DataFrame, key: str, message: str) -> DataFrame:
    """``joined`` unchanged; raises when a key of ``expected`` has no row in it. Runs one job, brings back five keys."""
    lost = expected.select(key).distinct().join(joined.select(key), key, "left_anti").take(5)
    if lost:
        raise ValueError(f"{message}: {', '.join(str(r[0]) for r in lost)}")
    return joined


def scenario_pairs(games: DataFrame, scenarios: DataFrame, how: str = "inner") -> DataFrame:
    """Every upcoming game with every home scenario and every guest scenario (bounded by the scenarios).

    With ``how`` "left", a team without scenarios has one, of NULL columns.
    """
    out = games
    for side in ("home", "guest"):
        named = scenarios.select(
            F.col("team_id").alias(f"{side}_team"),
            *[F.col(c).alias(f"{c}_{side}") for c in scenarios.columns if c != "team_id"])
        out = out.join(named, f"{side}_team", how)
    return out
