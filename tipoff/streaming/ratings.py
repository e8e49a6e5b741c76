"""Ratings as an event-time stream, one state per league."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tipoff.operators.ratings import EloRules, League, with_league

_GAME = ("game_id", "date", "season_id", "home_team", "guest_team", "pts_home", "pts_guest", "day")


class EloProcessor(StatefulProcessor):
    """Holds games back until the watermark passes their day, and rates them in (season_id, date, game_id) order then.

    State: one rating per team, the season, and the games held back. What a call costs follows from the games that it gets or releases and those
    held back, not from the games rated before. A game that is sent again while it is held back counts once.
    """

    def __init__(self, rules: EloRules, carry_over: bool, kinds: dict[str, T.DataType]):
        self.rules, self.carry_over, self.kinds = rules, carry_over, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.teams = handle.getMapState("ratings", T.StructType([T.StructField("team", self.kinds["home_team"])]), "rating double")
        self.season = handle.getValueState("season", T.StructType([T.StructField("season", self.kinds["season_id"])]))
        self.held = handle.getListState("held", T.StructType([T.StructField(c, self.kinds[c]) for c in _GAME]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["pts_home"].notna() & frame["pts_guest"].notna()]  # unplayed games only move the watermark
            if len(frame):
                self.held.appendList(list(frame[list(_GAME)].astype(object).itertuples(index=False, name=None)))
                self.handle.registerTimer(int(frame["day"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[object, tuple] = {}
        later: list[tuple] = []
        for game in self.held.get():
            if game[-1] <= now:
                due[game[0]] = tuple(game)
            else:
                later.append(tuple(game))
        if not due:  # an earlier timer of this batch has released them
            return iter(())
        if later:
            self.held.put(later)
            self.handle.registerTimer(int(min(game[-1] for game in later)))  # one timer waits for all that is held back
        else:
            self.held.clear()
        return iter([self._rated(key[0], sorted(due.values(), key=lambda g: (g[2], g[1], g[0])))])

    def _rated(self, name, games: list[tuple]) -> pd.DataFrame:
        league = League(self.rules, self.carry_over)
        if self.season.exists():
            league.season = self.season.get()[0]
            league.ratings = {k[0]: v[0] for k, v in self.teams.iterator()}
        out = []
        for game_id, date, season, home, guest, pts_home, pts_guest, _ in games:
            a0, a1, b0, b1 = league.play(season, home, guest, pts_home, pts_guest)
            out += [(name, game_id, date, season, home, a0, a1), (name, game_id, date, season, guest, b0, b1)]
        self.season.update((league.season,))
        self.teams.clear()
        for team, rating in league.ratings.items():
            self.teams.updateValue((team,), (float(rating),))
        return pd.DataFrame(out, columns=["league", "game_id", "date", "season_id", "team_id", "elo_before", "elo_after"])

    def close(self) -> None:
        pass


def elo_stream(games: DataFrame, rules: EloRules = EloRules(), carry_over: bool = True, delay: str = "30 days") -> DataFrame:
    """Two rated rows for each game, once no game of its day or before is awaited any more; equal to ``elo`` over all games.

    Games may arrive in any order and several times, at most ``delay`` behind the latest date seen; Spark drops later ones, which are left to
    ``elo_update``. The last days are released when a later date arrives, be it that of an unplayed game. Rows without date are never released.
    Needs the RocksDB state store.
    """
    timed = with_league(games).withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    rows = timed.select("league", "at", "game_id", "date", "season_id", "home_team", "guest_team", F.col("pts_home").cast("double").alias("pts_home"),
                        F.col("pts_guest").cast("double").alias("pts_guest"), F.unix_millis("at").alias("day"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    named = {"league": "league", "game_id": "game_id", "date": "date", "season_id": "season_id", "team_id": "home_team"}
    out = T.StructType([T.StructField(c, kinds[source]) for c, source in named.items()] + [T.StructField(c, T.DoubleType()) for c in ("elo_before", "elo_after")])
    return rows.where("date is not null").groupBy("league").transformWithStateInPandas(EloProcessor(rules, carry_over, kinds), out, "Append", "EventTime")
