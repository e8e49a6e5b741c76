"""Elo ratings with margin of victory, home advantage and season carry-over.

A rating depends on every earlier game of the league, so one league is one sequential pass; leagues run
in parallel. The pass is a stream over sorted Arrow batches with one rating per team in memory: no group
is ever materialised, and only six narrow columns are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.scalar import row_key
from tipoff.operators.ordered import Timeline, block_window, blocks, core_rows, with_ordinal

START, K_FACTOR, HOME_ADVANTAGE = 1500.0, 20.0, 100.0
CARRY, CARRY_MEAN = 0.75, 1505.0


@dataclass(frozen=True)
class EloRules:
    start: float = START
    k: float = K_FACTOR
    home: float = HOME_ADVANTAGE
    carry: float = CARRY
    mean: float = CARRY_MEAN

    def update(self, home: float, guest: float, pts_home: float, pts_guest: float) -> tuple[float, float]:
        """Ratings after one game. A tie counts as a guest win."""
        edge = home + self.home - guest
        upset = (edge > 0 and pts_home < pts_guest) or (edge < 0 and pts_home > pts_guest)
        favourite_edge = -abs(edge) if upset else abs(edge)
        factor = (abs(pts_home - pts_guest) + 3) ** 0.8 / (7.5 + 0.006 * favourite_edge)
        expected = 1 / (1 + 10 ** (-edge / 400))
        gain = self.k * factor * ((1.0 if pts_home > pts_guest else 0.0) - expected)
        return home + gain, guest - gain


@dataclass
class League:
    """Current ratings of one league; a new season starts from the regressed end of the season before."""

    rules: EloRules
    carry_over: bool
    season: int | None = None
    ratings: dict = field(default_factory=dict)

    def enter(self, season: int) -> None:
        if season != self.season:
            follows = self.carry_over and self.season is not None and season == self.season + 1
            r = self.rules
            self.ratings = {t: r.carry * v + (1 - r.carry) * r.mean for t, v in self.ratings.items()} if follows else {}
            self.season = season

    def play(self, season, home, guest, pts_home, pts_guest) -> tuple[float, float, float, float]:
        self.enter(season)
        a, b = self.ratings.get(home, self.rules.start), self.ratings.get(guest, self.rules.start)
        self.ratings[home], self.ratings[guest] = self.rules.update(a, b, pts_home, pts_guest)
        return a, self.ratings[home], b, self.ratings[guest]


def with_league(games: DataFrame) -> DataFrame:
    return games if "league" in games.columns else games.withColumn("league", F.lit(0).cast("bigint"))


def elo(games: DataFrame, carry_over: bool = True, rules: EloRules = EloRules(), seeds: DataFrame | None = None
        ) -> DataFrame:
    """Ratings before and after every played game, two rows per game, with the league if ``games`` has one.

    ``seeds`` (season_id, team_id, rating, optionally league) are end-of-season ratings to start from.
    """
    named = ["league"] if "league" in games.columns else []
    played = with_league(games).where(F.col("pts_home").isNotNull() & F.col("pts_guest").isNotNull())
    key_type, team_type = played.schema["game_id"].dataType, played.schema["home_team"].dataType
    rows = played.select(
        F.col("league").cast("bigint"), F.col("season_id").cast("bigint"), F.lit(1).alias("kind"), "date", "game_id",
        "home_team", "guest_team", F.col("pts_home").cast("double"), F.col("pts_guest").cast("double"))
    if seeds is not None:
        rows = rows.unionByName(with_league(seeds).select(
            F.col("league").cast("bigint"), F.col("season_id").cast("bigint"), F.lit(0).alias("kind"),
            F.lit(None).cast("date").alias("date"), F.lit(None).cast(key_type).alias("game_id"),
            F.col("team_id").cast(team_type).alias("home_team"), F.lit(None).cast(team_type).alias("guest_team"),
            F.col("rating").cast("double").alias("pts_home"), F.lit(None).cast("double").alias("pts_guest")))
    # one group = one league; without carry-over seasons are independent and run in parallel too
    group = ["league"] if carry_over or seeds is not None else ["league", "season_id"]
    # a fixed number of partitions, which Spark does not merge by their few bytes: the work is in the walk
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(wide, *group).sortWithinPartitions("league", "season_id", "kind", "date", "game_id")
    fields = ["league", "game_id", "date", "season_id", "team_id", "elo_before", "elo_after"]
    out = f"league long, game_id {key_type.simpleString()}, date date, season_id int, team_id {team_type.simpleString()}, " \
          "elo_before double, elo_after double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = League(rules, carry_over), None
        for batch in batches:
            result, kinds = [], dict(zip(batch.schema.names, batch.schema.types))
            for league, season, kind, date, game, home, guest, pts_home, pts_guest in zip(*(c.to_pylist() for c in batch.columns)):
                if league != at:
                    state, at = League(rules, carry_over), league
                if kind == 0:
                    state.season = season
                    state.ratings[home] = pts_home
                    continue
                a0, a1, b0, b1 = state.play(season, home, guest, pts_home, pts_guest)
                result.append((league, game, date, season, home, a0, a1))
                result.append((league, game, date, season, guest, b0, b1))
            types = [pa.int64(), kinds["game_id"], pa.date32(), pa.int32(), kinds["home_team"], pa.float64(), pa.float64()]
            columns = zip(*result) if result else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    return ordered.mapInArrow(walk, out).select(*named, *fields[1:])


def _rated_by(rated: DataFrame) -> list[str]:
    """What a rating belongs to: a team, in its league if there are several."""
    return (["league"] if "league" in rated.columns else []) + ["team_id"]


def final_ratings(rated: DataFrame, season: int | None = None) -> DataFrame:
    """Each team's last rating of a season (or of every season)."""
    rows = rated if season is None else rated.where(F.col("season_id") == season)
    return rows.groupBy("season_id", *_rated_by(rated)).agg(
        F.max_by("elo_after", F.struct("date", "game_id")).alias("rating"))


def elo_update(games: DataFrame, rated: DataFrame, rules: EloRules = EloRules()) -> DataFrame:
    """Ratings of the newest season's games that have a score but no rating yet.

    The season is rated again from the end of the season before, and only new rows are returned.
    """
    newest = F.broadcast(games.agg(F.max("season_id").alias("season_id")))  # one row
    season = games.join(newest, "season_id", "left_semi")
    before = rated.join(newest.select((F.col("season_id") - 1).alias("season_id")), "season_id", "left_semi")
    fresh = elo(season, rules=rules, seeds=final_ratings(before))
    return fresh.join(rated.select("game_id").distinct(), "game_id", "left_anti").select(
        row_key("game_id", "team_id").alias("id"), *fresh.columns)


def elo_change(rated: DataFrame, games_back: int = 7, column: str = "elo_before", size: int = 2048) -> DataFrame:
    """Absolute and relative change of a team's rating over its last games, across seasons."""
    line = Timeline(tuple(_rated_by(rated)))
    placed = blocks(with_ordinal(rated, line), games_back, size)
    then = F.lag(column, games_back).over(block_window(line))
    out = placed.select("*", then.alias("__then"))
    return core_rows(out).select(
        *rated.columns,
        (F.col(column) - F.col("__then")).alias(f"elo_change_{games_back}_absolute"),
        (F.try_divide(F.col(column), F.col("__then")) - 1).alias(f"elo_change_{games_back}_relative"))


def current_elo(rated: DataFrame, games_back: int = 7) -> DataFrame:
    """Latest rating and its recent change per team, for games still to come."""
    changed = elo_change(rated, games_back, "elo_after")
    columns = ["elo_after", f"elo_change_{games_back}_absolute", f"elo_change_{games_back}_relative"]
    last = F.max_by(F.struct(*columns), F.struct("date", "game_id")).alias("__last")
    by = _rated_by(rated)
    return changed.groupBy(*by).agg(last).select(*by, "__last.*")
