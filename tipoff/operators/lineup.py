"""Expected strength of a line-up from its players' form, and line-up scenarios for doubtful players."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tipoff.functions.scalar import blend, cap, is_available, ratio
from tipoff.operators.form import player_form
from tipoff.operators.kernels import Packed, by_group, divide, doubles, lengths
from tipoff.operators.ordered import UNBOUNDED
from tipoff.session import written

COUNTING = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pts"]
RATES = ["game_score", "plus_minus", "off_rtg", "def_rtg", "bpm"]
VOLATILE = ["pts", "off_rtg", "def_rtg", "plus_minus"]
THRESHOLDS = [0, 2, 4, 6, 8, 10]
GAME_MINUTES, PLAYER_MINUTES = 240.0, 48.0
ROTATION_MINUTES, BENCH_RANK, TOP_SHARE = 10.0, 5, 3
GAME_TEAM = ("game_id", "team_id")
LINE_UP_KEYS = (*GAME_TEAM, "player_id")


def recent_or_season(stat: str) -> Column:
    return F.coalesce(F.col(f"{stat}_7"), F.col(f"{stat}_109"))


def with_history(players: DataFrame) -> DataFrame:
    """Players with any minutes history, and the minutes that history suggests."""
    minutes = F.coalesce(F.col("mp_7"), F.col("mp_109"))
    return players.where(minutes.isNotNull()).select("*", minutes.alias("historical_minutes"))


def average_rank(keys, column: str) -> Column:
    """Descending rank in which ties share the mean of their places."""
    w = Window.partitionBy(*keys).orderBy(F.col(column).desc())
    through_peers = F.count(F.lit(1)).over(w.rangeBetween(UNBOUNDED, 0))
    return (F.rank().over(w) + through_peers) / 2


def ranked(players: DataFrame, keys=GAME_TEAM) -> DataFrame:
    """Place by historical minutes on a total order, and the average-method rank."""
    w = Window.partitionBy(*keys).orderBy(F.col("historical_minutes").desc(), F.col("player_id"))
    return players.select("*", F.row_number().over(w).alias("place")).select(
        "*", average_rank(keys, "historical_minutes").alias("minutes_rank"))


def top_players(players: DataFrame, n: int, keys=GAME_TEAM) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("historical_minutes").desc(), F.col("player_id"))
    return players.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def expected_minutes(players: DataFrame, keys=GAME_TEAM, counted: Column | None = None) -> DataFrame:
    """Share of the team's historical minutes, spread over 240, capped at 48, rescaled to exactly 240.

    The rescaled value may exceed the cap. Rows outside ``counted`` get no minutes.
    """
    team = Window.partitionBy(*keys)
    history = F.col("historical_minutes") if counted is None else F.when(counted, F.col("historical_minutes"))
    usage = players.select("*", ratio(history, F.sum(history).over(team)).alias("usage_rate"))
    capped = usage.select("*", cap(F.col("usage_rate") * GAME_MINUTES, PLAYER_MINUTES).alias("__capped"))
    return capped.select(
        "*", (F.col("__capped") * ratio(F.lit(GAME_MINUTES), F.sum("__capped").over(team))).alias("expected_minutes")
    ).drop("__capped")


def _weighted(stat: str) -> Column:
    return blend(f"{stat}_previous_game", f"{stat}_7", f"{stat}_109")


CHANGING = ["pts", "off_rtg", "plus_minus"]
PCTS = {f"exp_{a}_pct": (f"exp_{a}", f"exp_{b}") for a, b in (("fg", "fga"), ("fg3", "fg3a"), ("ft", "fta"))}

#: The player features that every input of a line-up's strength is made of, and the minutes that all need.
_MADE_OF = {
    **{f"blend_{s}": [f"{s}_{k}" for k in ("previous_game", "7", "109")] for s in COUNTING + RATES},
    **{f"volatility_{s}": [f"{s}_7_std"] for s in VOLATILE}, **{f"change_{s}": [f"{s}_7", f"{s}_109"] for s in CHANGING},
    "season_plus_minus": ["plus_minus_109"], "spread": ["pts_7_std", "pts_109_std"], "hot": ["pts_7", "pts_109"],
    "trending": ["plus_minus_7", "plus_minus_109"], "volatile": ["pts_7_std", "pts_109_std", "pts_7", "pts_109"]}
MINUTES = ["mp_7", "mp_109"]

#: The input behind every stat of a line-up that has one.
_INPUT_OF = {
    **{f"exp_{s}": f"blend_{s}" for s in COUNTING + RATES}, **{f"avg_{s}_volatility": f"volatility_{s}" for s in VOLATILE},
    **{f"{s}_recent_vs_season": f"change_{s}" for s in CHANGING}, **{f"players_pm109_gte_{t}": "season_plus_minus" for t in THRESHOLDS},
    "bench_avg_plus_minus": "season_plus_minus", "players_scoring_hot": "hot", "players_trending_positive": "trending",
    "team_consistency_score": "spread", "high_volatility_player_pct": "volatile"}


def _inputs_of(names: list[str]) -> list[str]:
    parts = {p for n in names for p in PCTS.get(n, (n,))}
    return [i for i in _MADE_OF if any(_INPUT_OF.get(n) == i for n in parts)]


def form_columns(names: list[str]) -> list[str]:
    """The player features that these stats of a line-up are made of."""
    return list(dict.fromkeys([*MINUTES, *[c for i in _inputs_of(names) for c in _MADE_OF[i]]]))


#: The player features that line-up strength is made of.
FORM_COLUMNS = form_columns(list(_INPUT_OF))


def _inputs() -> dict[str, Column]:
    """What one player adds to a line-up, from the player's form: one value a stat in place of three."""
    zero = F.lit(0.0)

    def change(stat: str) -> Column:
        return F.coalesce(recent_or_season(stat), zero) - F.coalesce(F.col(f"{stat}_109"), zero)

    spread, recent = F.coalesce(F.col("pts_7_std"), F.col("pts_109_std")), recent_or_season("pts")
    return {
        **{f"blend_{s}": _weighted(s) for s in COUNTING + RATES},
        **{f"volatility_{s}": F.coalesce(F.col(f"{s}_7_std"), zero) for s in VOLATILE},
        **{f"change_{s}": change(s) for s in ("pts", "off_rtg", "plus_minus")},
        "season_plus_minus": F.col("plus_minus_109"), "spread": spread,
        "hot": recent > F.coalesce(F.col("pts_109"), zero),
        "trending": recent_or_season("plus_minus") > F.coalesce(F.col("plus_minus_109"), F.lit(-999.0)),
        "volatile": F.coalesce(spread, zero) > F.coalesce(recent, zero),
    }


def input_values(names: list[str]) -> tuple[list[str], Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]]:
    """Names of the historical minutes and of the inputs behind the stats ``names``, and the function on arrays that makes them of the features
    ``form_columns(names)``: what ``with_history`` and ``_inputs`` say as columns, truth as 1 and 0, NaN for NULL."""
    wanted = _inputs_of(names)

    def values(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def first(*options: np.ndarray | str | float) -> np.ndarray:
            out, *rest = [of[o] if isinstance(o, str) else o for o in options]
            for other in rest:
                out = np.where(np.isnan(out), other, out)
            return out

        def recent(stat: str) -> np.ndarray:
            return first(f"{stat}_7", f"{stat}_109")

        def truth(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.where(np.isnan(left) | np.isnan(right), np.nan, left > right)

        def value(name: str) -> np.ndarray:
            kind, _, stat = name.partition("_")
            if kind == "blend":
                season = first(f"{stat}_109", 0.0)
                return 0.15 * first(f"{stat}_previous_game", season) + 0.35 * first(f"{stat}_7", season) + 0.50 * season
            if kind == "volatility":
                return first(f"{stat}_7_std", 0.0)
            if kind == "change":
                return first(recent(stat), 0.0) - first(f"{stat}_109", 0.0)
            if name == "season_plus_minus":
                return of["plus_minus_109"]
            if name == "hot":
                return truth(recent("pts"), first("pts_109", 0.0))
            if name == "trending":
                return truth(recent("plus_minus"), first("plus_minus_109", -999.0))
            spread = first("pts_7_std", "pts_109_std")
            return spread if name == "spread" else truth(first(spread, 0.0), first(recent("pts"), 0.0))

        return {"historical_minutes": first("mp_7", "mp_109"), **{n: value(n) for n in wanted}}

    return ["historical_minutes", *wanted], values


def line_up_inputs(players: DataFrame, *keep: str, only: list[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Players (with a history) by their inputs alone (or ``only`` some of these), so that no more is shuffled, and the columns by name."""
    inputs = {n: e for n, e in _inputs().items() if only is None or n in only}
    slim = players.select(*dict.fromkeys([*keep, "player_id", "historical_minutes"]), *[e.alias(n) for n, e in inputs.items()])
    return slim, {n: F.col(n) for n in inputs}


def strength(minutes: Column, of: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregates over the players who get ``minutes`` (others have NULL minutes). ``of`` has the inputs, if they are columns already."""
    of, total = of or _inputs(), F.sum(minutes)

    def mean(value: Column) -> Column:
        return ratio(F.sum(value * minutes), total)

    out = {"num_players": F.count(minutes), "total_minutes_check": total}
    for s in COUNTING:
        out[f"exp_{s}"] = F.sum(ratio(of[f"blend_{s}"] * minutes, "historical_minutes"))
    for s in RATES:
        out[f"exp_{s}"] = mean(of[f"blend_{s}"])
    for s in VOLATILE:
        out[f"avg_{s}_volatility"] = mean(of[f"volatility_{s}"])
    # points keep their weighted sum; the two ratings are averaged
    out["pts_recent_vs_season"] = F.sum(of["change_pts"] * minutes)
    for s in ("off_rtg", "plus_minus"):
        out[f"{s}_recent_vs_season"] = mean(of[f"change_{s}"])
    return out


def squad_counts(of: dict[str, Column] | None = None) -> dict[str, Column]:
    season = F.coalesce((of or _inputs())["season_plus_minus"], F.lit(-999.0))
    return {f"players_pm109_gte_{t}": F.count_if(season >= t) for t in THRESHOLDS}


def squad_indicators(of: dict[str, Column] | None = None) -> dict[str, Column]:
    """Depth, form and risk of everyone with a history (needs ``ranked`` rows)."""
    of, m = of or _inputs(), F.col("historical_minutes")
    return {
        "minutes_concentration": F.stddev_samp(m) / (F.avg(m) + 0.01),
        "top3_minutes_share": ratio(F.sum(F.when(F.col("place") <= TOP_SHARE, m)), F.sum(m)),
        "bench_avg_plus_minus": F.avg(F.when(F.col("minutes_rank") > BENCH_RANK, of["season_plus_minus"])),
        "rotation_size": F.count_if(m >= ROTATION_MINUTES),
        "players_scoring_hot": F.count_if(of["hot"]),
        "players_trending_positive": F.count_if(of["trending"]),
        "team_consistency_score": 1 / (F.avg(F.coalesce(of["spread"], F.lit(99.0))) + 0.1),
        "high_volatility_player_pct": F.count_if(of["volatile"]) / F.count(F.lit(1)),
    }


Finish = Callable[[np.ndarray], np.ndarray]


class _Squads:
    """Stats of many line-ups at a time: groups of players in order of minutes, which begin at the rows ``first``. NaN stands for NULL.

    The same maths as the columns of ``strength``, ``squad_counts`` and ``squad_indicators``.
    """

    def __init__(self, table: pa.Table, first: np.ndarray, top_n: int):
        self.table, self.first, self.n = table, first, lengths(first, table.num_rows)
        self.m, at = self.column("historical_minutes"), np.arange(table.num_rows)
        self.place = at - np.repeat(first, self.n) + 1
        peers = np.ones(len(at), bool)
        peers[1:] = self.m[1:] != self.m[:-1]
        peers[first] = True
        ties = np.flatnonzero(peers)
        size = lengths(ties, len(at))
        self.rank = np.repeat(self.place[ties] + (size - 1) / 2, size)
        self.counted = self.place <= top_n
        history = np.where(self.counted, self.m, np.nan)
        capped = np.minimum(divide(history, self.each(self.total(history))) * GAME_MINUTES, PLAYER_MINUTES)
        self.minutes = capped * self.each(divide(GAME_MINUTES, self.total(capped)))
        self.all_minutes = self.total(self.minutes)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).cast(pa.float64()).to_numpy()

    def each(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.n)

    def count(self, hit: np.ndarray) -> np.ndarray:
        return np.add.reduceat(hit.astype(np.int64), self.first)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of the known values, NaN where there is none."""
        known = ~np.isnan(values)
        return np.where(self.count(known) > 0, np.add.reduceat(np.where(known, values, 0.0), self.first), np.nan)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return divide(self.total(values), self.count(~np.isnan(values)))

    def concentration(self) -> np.ndarray:
        away = self.m - self.each(self.m[self.first])  # exactly zero for equal minutes
        centred = away - self.each(np.add.reduceat(away, self.first) / self.n)
        spread = np.sqrt(divide(np.add.reduceat(centred * centred, self.first), self.n - 1))
        return spread / (np.add.reduceat(self.m, self.first) / self.n + 0.01)

    def stat(self, name: str) -> np.ndarray:
        if name in PCTS:
            return divide(*map(self.stat, PCTS[name]))
        if name.startswith("players_pm109_gte_"):  # an unknown value is below every threshold
            return self.count(self.column("season_plus_minus") >= int(name.rpartition("_")[2]))
        plain = {
            "num_players": lambda: self.count(self.counted), "total_minutes_check": lambda: self.all_minutes,
            "minutes_concentration": self.concentration,
            "top3_minutes_share": lambda: divide(self.total(np.where(self.place <= TOP_SHARE, self.m, np.nan)), self.total(self.m)),
            "rotation_size": lambda: self.count(self.m >= ROTATION_MINUTES)}
        if name in plain:
            return plain[name]()
        value = self.column(_INPUT_OF[name])
        if name in ("players_scoring_hot", "players_trending_positive"):
            return self.count(value == 1)
        if name == "high_volatility_player_pct":
            return self.count(value == 1) / self.n
        if name == "bench_avg_plus_minus":
            return self.mean(np.where(self.rank > BENCH_RANK, value, np.nan))
        if name == "team_consistency_score":
            return 1 / (self.mean(np.where(np.isnan(value), 99.0, value)) + 0.1)
        if name in [f"exp_{s}" for s in COUNTING]:
            return self.total(divide(value * self.minutes, self.m))
        weighted = self.total(value * self.minutes)
        return weighted if name == "pts_recent_vs_season" else divide(weighted, self.all_minutes)


#: Every stat of a line-up, in the order of ``expected_team_stats``.
TEAM_STATS = [
    "num_players", "total_minutes_check", *[f"exp_{s}" for s in COUNTING + RATES], *[f"avg_{s}_volatility" for s in VOLATILE],
    *[f"{s}_recent_vs_season" for s in CHANGING], *[f"players_pm109_gte_{t}" for t in THRESHOLDS],
    "minutes_concentration", "top3_minutes_share", "bench_avg_plus_minus", "rotation_size", "players_scoring_hot", "players_trending_positive",
    "team_consistency_score", "high_volatility_player_pct", *PCTS]
_WHOLE = {"num_players", "rotation_size", "players_scoring_hot", "players_trending_positive", *[f"players_pm109_gte_{t}" for t in THRESHOLDS]}


def form_stats(player_box: DataFrame, top_n: int = 10, names: list[str] | None = None, finish: Finish | None = None) -> DataFrame:
    """``team_stats`` of a ``player_box`` with the stats behind them: the form's tasks return the line-ups' inputs, not the features."""
    names = list(TEAM_STATS if names is None else names)
    inputs = player_form(player_box, columns=form_columns(names), derived=input_values(names), keep=LINE_UP_KEYS)
    return _of_inputs(inputs.where("historical_minutes is not null"), _inputs_of(names), top_n, GAME_TEAM, names, finish)


def team_stats(players: DataFrame, top_n: int = 10, keys=GAME_TEAM, names: list[str] | None = None) -> DataFrame:
    """The stats ``names`` (all of ``TEAM_STATS`` if not given) of ``expected_team_stats``, on Arrow batches of whole line-ups.

    One shuffle on ``keys`` by the inputs that the names need. ``players`` need the features ``form_columns(names)``.
    """
    names = list(TEAM_STATS if names is None else names)
    slim, of = line_up_inputs(with_history(players), *keys, only=_inputs_of(names))
    return _of_inputs(slim, list(of), top_n, keys, names)


def _of_inputs(slim: DataFrame, inputs: list[str], top_n: int, keys, names: list[str], finish: Finish | None = None) -> DataFrame:
    """``finish`` is applied to the values of every stat that is a double."""
    schema = T.StructType([slim.schema[k] for k in keys] + [
        T.StructField(n, T.LongType() if n in _WHOLE else T.DoubleType()) for n in names])
    arrow_schema = to_arrow_schema(schema)

    def line_ups(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        squads = _Squads(table, first, top_n)
        kept = table.select(keys).take(pa.array(first)).combine_chunks()
        out = [kept.column(k).combine_chunks().cast(arrow_schema.field(k).type) for k in keys]
        for n in names:
            value = squads.stat(n)
            out += [pa.array(value)] if n in _WHOLE else doubles((finish(value) if finish else value)[None])
        return pa.RecordBatch.from_arrays(out, schema=arrow_schema)

    packed = Packed(slim.select(*keys, "historical_minutes", *inputs))

    def walk(batches):
        return by_group(map(packed.unpack, batches), list(keys), line_ups)

    dealt = slim.select(*keys, "player_id", "historical_minutes", *inputs).repartition(*keys)
    in_order = dealt.sortWithinPartitions(*keys, F.col("historical_minutes").desc(), "player_id")
    return packed.pack(in_order).mapInArrow(walk, schema)


def expected_team_stats(players: DataFrame, top_n: int = 10, keys=GAME_TEAM, dealt_by: str | None = None) -> DataFrame:
    """One row per (game, team): minutes-weighted strength of the top players plus whole-squad indicators.

    Without ``dealt_by``, ``team_stats`` has them. With it, which is one of the keys, all is done by columns and stays dealt out by that key,
    as long as a caller needs it for the next step: ranks, minute shares and the final aggregation all use the same partitioning.
    """
    if not dealt_by:
        return team_stats(players, top_n, keys)
    slim, of = line_up_inputs(with_history(players), *keys)
    rows = ranked(slim.repartition(dealt_by), keys)
    rows = expected_minutes(rows, keys, counted=F.col("place") <= top_n)
    aggregates = {**strength(F.col("expected_minutes"), of), **squad_counts(of), **squad_indicators(of)}
    # a player in the rotation without a usable history still counts as a player
    aggregates["num_players"] = F.count_if(F.col("place") <= top_n)
    stats = rows.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return stats.select("*", *[ratio(a, b).alias(n) for n, (a, b) in PCTS.items()])


def home_away_features(players: DataFrame, games: DataFrame, top_n: int = 10) -> DataFrame:
    """Expected stats of both sides in one row per game, prefixed ``home_`` and ``away_``.

    Players are dealt out by game, so both sides of a game are in one partition and are put side by side without another shuffle.
    """
    stats = expected_team_stats(players, top_n, dealt_by="game_id")
    sides = {"home": F.col("team_id") == F.col("home_team"), "away": F.col("team_id") == F.col("guest_team")}
    # a number for each row of ``games``, as its keys may come twice
    both = stats.join(games.select("game_id", "home_team", "guest_team", F.monotonically_increasing_id().alias("__row")), "game_id").where(
        sides["home"] | sides["away"])
    values = [c for c in stats.columns if c not in GAME_TEAM]
    out = both.groupBy("game_id", "__row").agg(
        *[F.max(here).alias(f"__{side}") for side, here in sides.items()],
        *[F.max(F.when(here, F.col(c))).alias(f"{side}_{c}") for side, here in sides.items() for c in values])
    return out.where("__home and __away").drop("__row", "__home", "__away")


# ---------------------------------------------------------------------------
# Scenarios
# ---------------------------------------------------------------------------

def available(roster: DataFrame) -> DataFrame:
    """Everyone healthy or day-to-day; ``doubtful`` marks the latter."""
    return roster.where(is_available("injury")).select(
        "team_id", "player_id", "player_name", F.col("injury").isNotNull().alias("doubtful"))


def roster_scenarios(roster: DataFrame) -> DataFrame:
    """All healthy players with every subset of the doubtful ones: 2^k scenarios per team.

    The number of scenarios doubles per doubtful player, so ask for the teams that are needed only.
    Bit ``i`` of ``scenario_id`` tells whether the i-th doubtful player plays.
    """
    squad = available(roster)
    team = Window.partitionBy("team_id")
    numbered = squad.select(
        "*", F.count_if("doubtful").over(team).alias("k"),
        (F.count_if("doubtful").over(team.orderBy("player_id").rowsBetween(UNBOUNDED, 0)) - 1).alias("bit"))
    last = F.pow(F.lit(2.0), F.col("k")).cast("bigint") - 1
    spread = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("scenario_id"))
    plays = F.expr("cast(floor(scenario_id / pow(2, bit)) as bigint) % 2 = 1")
    return spread.where(~F.col("doubtful") | plays).select("team_id", "scenario_id", "player_id", "doubtful")


def scenario_ids(roster: DataFrame) -> DataFrame:
    """(team_id, scenario_id) of ``roster_scenarios``, the empty line-up included, without a copy of any player."""
    teams = available(roster).groupBy("team_id").agg(F.count_if("doubtful").alias("k"))
    last = F.pow(F.lit(2.0), F.col("k")).cast("bigint") - 1
    return teams.select("team_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("scenario_id"))


#: Counts over a whole squad, which add up.
_COUNTS = ["rotation_size", "players_scoring_hot", "players_trending_positive"]


def _squad_parts(of: dict[str, Column]) -> dict[str, Column]:
    """What ``squad_counts`` and ``squad_indicators`` are made of, for a part of a squad (needs ``minutes_rank``)."""
    m = F.col("historical_minutes")
    on_bench = F.when(F.col("minutes_rank") > BENCH_RANK, of["season_plus_minus"])
    counts = squad_indicators(of)
    return {
        "n": F.count(F.lit(1)), "minutes": F.sum(m), "scatter": F.var_pop(m) * F.count(m), "bench": F.sum(on_bench), "bench_n": F.count(on_bench),
        "spread": F.sum(F.coalesce(of["spread"], F.lit(99.0))), "volatile": F.count_if(of["volatile"]), **{c: counts[c] for c in _COUNTS}, **squad_counts(of)}


def _joined_parts(a: str, b: str) -> dict[str, Column]:
    """Counts and indicators of two parts of a squad (structs of ``_squad_parts``; the second may be NULL)."""
    def part(struct, name):
        return F.coalesce(F.col(f"{struct}.{name}"), F.lit(0))

    def both(name):
        return part(a, name) + part(b, name)

    n = both("n")
    apart = part(a, "minutes") / part(a, "n") - F.coalesce(ratio(part(b, "minutes"), part(b, "n")), F.lit(0.0))
    scatter = both("scatter") + apart * apart * part(a, "n") * part(b, "n") / n
    return {
        **{c: both(c) for c in squad_counts()},
        "minutes_concentration": F.when(n > 1, F.sqrt(scatter / F.greatest(n - 1, F.lit(1)))) / (both("minutes") / n + 0.01),
        "top3_minutes_share": ratio(F.col("__top"), both("minutes")),
        "bench_avg_plus_minus": ratio(both("bench"), both("bench_n")),
        **{c: both(c) for c in _COUNTS},
        "team_consistency_score": 1 / (both("spread") / n + 0.1),
        "high_volatility_player_pct": both("volatile") / n,
    }


def _line_ups(squad: DataFrame, features: list[str]) -> DataFrame:
    """Every line-up that differs in its features, one row for each of its players.

    Doubtful players of a team with equal features are one kind, of which 0 up to all play: the first by player_id. A scenario is a number whose
    digits, one for each kind, say how many.
    """
    team, kind = Window.partitionBy("team_id"), Window.partitionBy("team_id", "doubtful", *features)
    alike = squad.select(
        "*", F.when(F.col("doubtful"), F.count(F.lit(1)).over(kind)).otherwise(0).alias("__of"), F.min("player_id").over(kind).alias("__kind"),
        (F.row_number().over(kind.orderBy("player_id")) - 1).alias("__nth"))
    choices = F.when(F.col("doubtful") & (F.col("__nth") == 0), F.col("__of") + 1).otherwise(1)
    through = team.orderBy("__kind", "player_id").rowsBetween(UNBOUNDED, 0)
    digits = alike.select("*", F.product(choices).over(team).cast("bigint").alias("__all"),
                          (F.product(choices).over(through) / (F.col("__of") + 1)).cast("bigint").alias("__place"))
    spread = digits.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__all") - 1)).alias("scenario_id"))
    plays = F.expr("scenario_id div __place % (__of + 1) > __nth")
    return spread.where(~F.col("doubtful") | plays).drop("__of", "__kind", "__nth", "__all", "__place")


def scenario_stats(roster: DataFrame, player_features: DataFrame, top_n: int = 10) -> DataFrame:
    """Expected stats per scenario from each player's latest form; scenarios with equal results appear once.

    The roster decides the team, so a traded player counts for the new team. Doubtful players without a history change nothing and make no scenarios,
    equal ones are interchangeable. Healthy players behind the first ten are in every scenario and never in a rotation: they are summed up
    once for each team, and only the players before them and the doubtful ones are repeated. The number of scenarios still doubles with each doubtful player unlike the others.
    """
    minutes = F.coalesce(F.col("mp_7"), F.col("mp_109")).alias("historical_minutes")
    slim, of = line_up_inputs(player_features.select("*", minutes), "date", "game_id")
    features = ["historical_minutes", *of]
    last = F.max_by(F.struct(*features), F.struct("date", "game_id")).alias("__last")
    latest = written(slim.groupBy("player_id").agg(last).select("player_id", "__last.*"), "latest")  # read for both parts of a squad
    squad = available(roster).drop("player_name").join(latest, "player_id").where("historical_minutes is not null")
    line = Window.partitionBy("team_id", "doubtful").orderBy(F.col("historical_minutes").desc(), F.col("player_id"))
    deep = max(top_n, 2 * BENCH_RANK)  # whoever has so many before them is on the bench, ties included
    behind = ~F.col("doubtful") & (F.col("__in_line") > deep)
    squad = squad.select("*", F.row_number().over(line).alias("__in_line"))
    parts = F.struct(*[e.alias(n) for n, e in _squad_parts(of).items()])
    rest = squad.where(behind).select("*", F.lit(deep + 1.0).alias("minutes_rank")).groupBy("team_id").agg(parts.alias("__rest"))

    keys = ("team_id", "scenario_id")
    rows = ranked(_line_ups(squad.where(~behind).drop("__in_line"), features), keys)
    rows = expected_minutes(rows, keys, counted=F.col("place") <= top_n)
    rotation = {**strength(F.col("expected_minutes"), of), "num_players": F.count_if(F.col("place") <= top_n)}
    top = F.sum(F.when(F.col("place") <= TOP_SHARE, F.col("historical_minutes"))).alias("__top")
    stats = rows.groupBy(*keys).agg(*[e.alias(n) for n, e in rotation.items()], top, parts.alias("__front")).join(rest, "team_id", "left")
    return stats.select(
        "team_id", *rotation, *[e.alias(n) for n, e in _joined_parts("__front", "__rest").items()],
        *[ratio(a, b).alias(n) for n, (a, b) in PCTS.items()]).distinct()
