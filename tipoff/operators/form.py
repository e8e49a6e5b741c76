"""Recent form: lagged values, rolling and exponentially weighted statistics, streaks, ratios.

Every value describes the games *before* the row's game. All bounded look-backs run on
``ordered.blocks`` and cost a constant number of operations per row: rolling sums are differences of
running sums inside a block, and exponential weights are running sums of re-based weights.

``Form`` computes a few columns with JVM windows. ``team_form`` and ``player_form`` compute the full
blocks (347 and 140 columns) with the same maths on Arrow batches of whole bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tipoff.functions.scalar import ratio
from tipoff.operators.kernels import Packed, Sums, by_group, divide, doubles, lag, lengths, matrix, weighted_mean
from tipoff.operators.ordered import (
    BLOCK, ORDINAL, PLAYER_SEASON, TEAM_SEASON, TOTAL, UNBOUNDED, Timeline, block_size, block_window, blocks,
    core_rows, ewm_halo, ewm_keep, long_entities, running, with_ordinal,
)
from tipoff.session import written

WINDOWS = (7, 109)
FULL_SEASON = 109
BLOWOUT_MARGIN = 15

TEAM_ABSOLUTE = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pts",
                 "pace", "tov_diff", "poss_diff"]
TEAM_PER_100 = ["tov_pct", "off_rtg", "def_rtg", "net_rtg"]
TEAM_OPPONENT = [f"{c}_opponent" for c in ("drb", "orb", "trb", "fg", "fga", "fta", "fg3", "pts", "tov")]
TEAM_STATS = TEAM_ABSOLUTE + TEAM_PER_100 + TEAM_OPPONENT
PLAYER_STATS = ["mp", "fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pts",
                "game_score", "plus_minus", "off_rtg", "def_rtg", "bpm"]
PLAYER_KEYS = ["game_id", "date", "season_id", "player_id", "team_id"]
NEAR_ZERO = 1e-9  # a mean this small is a sum of cancelling doubles, not a divisor
RATIO_STD = ["fg_pct", "fg3_pct", "ft_pct", "ts_pct", "eff_fg_pct"]


def min_games(window: int, impute: bool, always: bool = False) -> int:
    """Games needed before a windowed value is given."""
    return 1 if (window >= FULL_SEASON or impute or always) else window


def window_ratios(m: Callable, ratio: Callable = ratio) -> dict:
    """The 18 shooting, passing and rebounding ratios of one window, from the window means ``m(name)``.

    Works on Columns and on arrays alike; ``ratio`` is the matching division.
    """

    def attempts(suffix: str = ""):
        return m(f"fga{suffix}") + 0.44 * m(f"fta{suffix}")

    return {
        "fg_pct": ratio(m("fg"), m("fga")),
        "fg3_pct": ratio(m("fg3"), m("fg3a")),
        "ft_pct": ratio(m("ft"), m("fta")),
        "ast_pct": ratio(m("ast"), m("fg")),
        "ast_to_tov": ratio(m("ast"), m("tov")),
        "fta_rate": ratio(m("fta"), m("fga")),
        "fg2a_pct": 1 - ratio(m("fg3a"), m("fga")),
        "pts_pct_2": ratio(2 * (m("fg") - m("fg3")), m("pts")),
        "ptc_pct_ft": ratio(m("ft"), m("pts")),
        "eff_fg_pct": ratio(m("fg") + 0.5 * m("fg3"), m("fga")),
        "ts_pct": ratio(m("pts"), 2 * attempts()),
        "ast_rat": ratio(100 * m("ast"), attempts() + m("tov") + m("ast")),
        "trb_pct": ratio(m("trb"), m("trb") + m("trb_opponent")),
        "drb_pct": ratio(m("drb"), m("drb") + m("orb_opponent")),
        "orb_pct": ratio(m("orb"), m("orb") + m("drb_opponent")),
        "fta_rate_opponent": ratio(m("fta_opponent"), m("fga_opponent")),
        "eff_fg_pct_opponent": ratio(m("fg_opponent") + 0.5 * m("fg3_opponent"), m("fga_opponent")),
        "ts_pct_opponent": ratio(m("pts_opponent"), 2 * attempts("_opponent")),
    }


def vs_average_names(columns: list[str], short: int, long: int) -> dict[str, tuple[str, str]]:
    """Recent over season for every column that ends with the short window (standard deviations do not)."""
    recent = [c for c in columns if c.endswith(f"_{short}")]
    return {c.replace(f"_{short}", "_vs_avg"): (c, c.replace(f"_{short}", f"_{long}")) for c in recent}


def vs_average(df: DataFrame, short: int, long: int) -> dict[str, Column]:
    return {name: ratio(a, F.when(F.abs(F.col(b)) > NEAR_ZERO, F.col(b)))
            for name, (a, b) in vs_average_names(df.columns, short, long).items()}


# ---------------------------------------------------------------------------
# Rolling machinery
# ---------------------------------------------------------------------------

def placed(df: DataFrame, line: Timeline, windows, spans=(), reach: int = 1, size: int | None = None) -> DataFrame:
    """Give rows their ordinal and spread them over blocks whose halo covers every look-back."""
    size = size or block_size(list(spans))
    halo = max([reach * w + 1 for w in windows] + [ewm_halo(s) for s in spans] + [1])
    rows = df if ORDINAL in df.columns else with_ordinal(df, line)
    # the block size travels with the rows, because weights are re-based to each block's first row
    return blocks(rows, halo, size).withColumn("__first", F.col(BLOCK) * size)


class Form:
    """Adds rolling columns to rows that were ``placed``; all of them share one sort."""

    def __init__(self, df: DataFrame, line: Timeline):
        self.df, self.line = df, line
        self.w = block_window(line)
        self.before = self.w.rowsBetween(UNBOUNDED, -1)
        self.to_here = self.w.rowsBetween(UNBOUNDED, 0)

    def _add(self, columns: dict[str, Column]) -> "Form":
        if columns:
            self.df = self.df.select("*", *[c.alias(n) for n, c in columns.items()])
        return self

    def lagged(self, stats: list[str]) -> "Form":
        return self._add({f"{c}_previous_game": F.lag(c, 1).over(self.w) for c in stats})

    def _accumulate(self, stats, spread: bool, include_current: bool) -> dict[str, Column]:
        frame = self.to_here if include_current else self.before
        out = {}
        for c in stats:
            value = F.col(c)
            if spread:
                # deviations from the block's first value: a constant series then has exactly zero spread
                value = F.col(c) - F.col(f"__{c}_0")
                out[f"__{c}_q"] = F.sum(value * value).over(frame)
            out[f"__{c}_s"] = F.sum(value).over(frame)
            out[f"__{c}_c"] = F.count(F.col(c)).over(frame)
        return out

    def _origin(self, stats) -> "Form":
        whole = self.w.rowsBetween(UNBOUNDED, Window.unboundedFollowing)
        return self._add({f"__{c}_0": F.first(c, ignorenulls=True).over(whole) for c in stats})

    def rolling(
        self, stats: list[str], windows, least: Callable[[str, int], int], *, mean="{c}_{w}", std="{c}_{w}_std",
        total=None, include_current: bool = False,
    ) -> "Form":
        """Mean and sample standard deviation (or total) over the last ``w`` rows.

        ``least(stat, window)`` is the number of values a window needs. The row itself counts only with
        ``include_current``, which is meant for series that are already lagged.
        """
        spread = std is not None
        if spread or mean:
            self._origin(stats)
        self._add(self._accumulate(stats, spread or bool(mean), include_current))
        parts = ("s", "c") + (("q",) if spread else ())
        self._add({
            f"__{c}_{p}_{w}": F.col(f"__{c}_{p}") - F.coalesce(F.lag(f"__{c}_{p}", w).over(self.w), F.lit(0))
            for c in stats for p in parts for w in windows
        })
        out = {}
        for c in stats:
            for w in windows:
                n, s = F.col(f"__{c}_c_{w}"), F.col(f"__{c}_s_{w}")
                enough = n >= F.lit(max(1, least(c, w)))
                if mean:
                    out[mean.format(c=c, w=w)] = F.when(enough, ratio(F.col(f"__{c}_0") * n + s, n))
                if spread:
                    var = F.try_divide(F.col(f"__{c}_q_{w}") - ratio(s * s, n), n - 1)
                    out[std.format(c=c, w=w)] = F.when(enough & (n > 1), F.sqrt(F.greatest(var, F.lit(0.0))))
                if total:
                    out[total.format(c=c, w=w)] = F.when(enough, s)
        return self._add(out)

    def weighted(self, stats: list[str], spans, least: Callable[[str, int], int], name="{c}_ewm_{w}") -> "Form":
        """Exponentially weighted mean, span ``w``, weights adjusted, over the whole history.

        The weights start at the first value; a NULL keeps its place but adds to neither sum. Rows whose
        weight is below double precision lie outside the halo.
        """
        age = F.col(ORDINAL) - F.col("__first")
        sums = {}
        for s in spans:
            # weight grows with the row's place in the block, which equals a decay seen from any later row
            weight = F.when(age >= -ewm_halo(s), F.exp(age * -math.log(ewm_keep(s))))
            for c in stats:
                sums[f"__{c}_n_{s}"] = F.sum(F.col(c) * weight).over(self.before)
                sums[f"__{c}_d_{s}"] = F.sum(F.when(F.col(c).isNotNull(), weight)).over(self.before)
        counts = {f"__{c}_k": F.count(F.col(c)).over(self.before)
                  for c in stats if f"__{c}_c" not in self.df.columns and any(least(c, s) > 1 for s in spans)}
        self._add({**sums, **counts})
        out = {}
        for c in stats:
            for s in spans:
                mean = F.try_divide(F.col(f"__{c}_n_{s}"), F.col(f"__{c}_d_{s}"))
                if least(c, s) > 1:
                    seen = f"__{c}_c" if f"__{c}_c" in self.df.columns else f"__{c}_k"
                    mean = F.when(F.col(seen) >= least(c, s), mean)
                out[name.format(c=c, w=s)] = mean
        return self._add(out)

    def done(self, columns: list[str]) -> DataFrame:
        return core_rows(self.df).select(*columns)


# ---------------------------------------------------------------------------
# Streaks
# ---------------------------------------------------------------------------

def streaks(rows: DataFrame, line: Timeline = TEAM_SEASON, result: str = "is_win") -> DataFrame:
    """Result of the last game and the length of the current winning / losing streak before each game.

    A streak reaches back to the last game with another outcome, however far away that is, so it is the
    distance to a last-known ordinal instead of a run-length scan. An unplayed game ends both streaks.
    """
    if ORDINAL not in rows.columns:
        rows = with_ordinal(rows, line)
    code = F.coalesce(F.col(result).cast("int"), F.lit(-1))
    marked = running(rows, line, lasts={
        "__last": code,
        "__not_won": F.when(code != 1, F.col(ORDINAL)),
        "__not_lost": F.when(code != 0, F.col(ORDINAL)),
    })

    def length(outcome: int, broken: str) -> Column:
        since = F.col(ORDINAL) - 1 - F.coalesce(F.col(broken), F.lit(-1))
        return F.when(F.col("__last") == outcome, since).otherwise(F.lit(0)).cast("bigint")

    return marked.select(
        *rows.columns,
        F.when(F.col("__last") >= 0, F.col("__last") == 1).alias("has_won_last_game"),
        length(1, "__not_won").alias("current_winning_streak"),
        length(0, "__not_lost").alias("current_losing_streak"),
    )


# ---------------------------------------------------------------------------
# The two feature blocks
# ---------------------------------------------------------------------------

Compute = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _block_apply(rows: DataFrame, line: Timeline, carried: list[str], stats: list[str], compute: Compute, names: list[str],
                 latest: bool = False, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Run ``compute(matrix, first rows of the groups, age)`` on many groups at a time and return the carried columns plus ``names`` as doubles.

    A group is a block of ``placed`` rows, or, without blocks, all rows of an entity. With ``latest``, only a group's last row is returned.
    ``finish`` is applied to the values of each of the ``names``.
    """
    schema = T.StructType([rows.schema[c] for c in carried] + [T.StructField(n, T.DoubleType()) for n in names])
    arrow_schema = to_arrow_schema(schema)
    cut = BLOCK in rows.columns
    keys = [*line.keys, BLOCK] if cut else list(line.keys)

    def whole_blocks(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        n = table.num_rows
        if cut:
            age = table.column(ORDINAL).to_numpy() - table.column("__first").to_numpy()
        else:
            age = np.arange(n) - np.repeat(first, lengths(first, n))
        features = compute(matrix(table, stats), first, age)
        out = np.stack([features[name] for name in names]) if names else np.empty((0, n))
        kept = table.select(carried)
        if latest:
            last = first + lengths(first, n) - 1  # a row of the block's own: its halo lies before it
            out, kept = out[:, last], kept.take(pa.array(last))
        elif cut:
            core = age >= 0
            out, kept = out[:, core], kept.filter(pa.array(core))
        if finish:
            out = np.stack([finish(values) for values in out]) if names else out
        kept = kept.combine_chunks()
        columns = [kept.column(c).combine_chunks().cast(arrow_schema.field(c).type) for c in carried]
        return pa.RecordBatch.from_arrays(columns + doubles(out), schema=arrow_schema)

    order = [ORDINAL] if cut else [line.chunk, *line.order]
    read = list(dict.fromkeys([*keys, *carried, *([ORDINAL, "__first"] if cut else []), *stats]))
    slim = rows.select(*dict.fromkeys([*read, *order]))
    packed = Packed(slim.select(*read), [c for c in stats if isinstance(slim.schema[c].dataType, T.DoubleType) and c not in (*keys, *carried, *order)])

    def walk(batches):
        return by_group(map(packed.unpack, batches), keys, whole_blocks)

    # a fixed partition count: adaptive coalescing judges by bytes and would leave the arithmetic to few tasks
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key first: many entities share a season, and rows that differ in the first column are told apart soonest
    return packed.pack(packed.shrink(slim).repartition(parts, *keys).sortWithinPartitions(*reversed(keys), *order)).mapInArrow(walk, schema)


def _basic_names(stats: list[str], windows) -> list[str]:
    return [f"{c}_previous_game" for c in stats] + [n for w in windows for c in stats for n in (f"{c}_{w}", f"{c}_ewm_{w}", f"{c}_{w}_std")]


def _basic_columns(x: np.ndarray, first: np.ndarray, age: np.ndarray, stats: list[str], windows, impute: bool,
                   always: set[str], wanted: list[str] | None = None) -> dict[str, np.ndarray]:
    """Previous game, rolling mean, weighted mean and standard deviation of every stat, or those of them that are ``wanted``."""
    names = _basic_names(stats, windows) if wanted is None else wanted
    asked, out = set(names), {}

    def part(pattern: str) -> tuple[list[str], np.ndarray]:
        some = [c for c in stats if pattern.format(c) in asked]
        return some, x if len(some) == len(stats) else x[:, [stats.index(c) for c in some]]

    some, values = part("{}_previous_game")
    if some:
        out.update(zip([f"{c}_previous_game" for c in some], lag(values, first).T))
    spreads = [any(f"{c}_{w}_std" in asked for w in windows) for c in stats]
    for spread in (False, True):  # squares are summed only for the stats whose spread is asked for
        mine = [j for j, c in enumerate(stats) if spreads[j] == spread and any(f"{c}_{w}" in asked or f"{c}_{w}_std" in asked for w in windows)]
        if not mine:
            continue
        sums = Sums(x[:, mine], first, spread=spread)
        for w in windows:
            mean, _ = sums.window(w, np.array([min_games(w, impute, stats[j] in always) for j in mine]))
            out.update((f"{stats[j]}_{w}", mean[:, i]) for i, j in enumerate(mine) if f"{stats[j]}_{w}" in asked)
            if spread:
                std = sums.deviation(w, min_games(w, impute))
                out.update((f"{stats[j]}_{w}_std", std[:, i]) for i, j in enumerate(mine) if f"{stats[j]}_{w}_std" in asked)
    for w in windows:
        some, values = part(f"{{}}_ewm_{w}")
        if some:
            ewm = weighted_mean(values, first, age, ewm_keep(w), ewm_halo(w))
            if min_games(w, impute) > 1:
                ewm = np.where(Sums(values, first, spread=False).seen() >= min_games(w, impute), ewm, np.nan)
            out.update(zip([f"{c}_ewm_{w}" for c in some], ewm.T))
    return {n: out[n] for n in names}


def _team_columns(x: np.ndarray, first: np.ndarray, age: np.ndarray, windows, impute: bool) -> dict[str, np.ndarray]:
    stats = TEAM_STATS
    out = _basic_columns(x, first, age, stats, windows, impute, set())
    diff = (x[:, stats.index("pts")] - x[:, stats.index("pts_opponent")])[:, None]
    out["pts_diff_previous_game"] = lag(diff, first)[:, 0]
    for name, hit in (("blowout_wins", diff >= BLOWOUT_MARGIN), ("blowout_losses", diff <= -BLOWOUT_MARGIN)):
        sums = Sums(np.where(np.isnan(diff), np.nan, hit.astype(np.float64)), first, spread=False)
        for w in windows:
            out[f"{name}_{w}"] = sums.window(w, min_games(w, impute))[1][:, 0]
    for w in windows:
        for name, values in window_ratios(lambda c: out[f"{c}_{w}"], divide).items():
            out[f"{name}_{w}"] = values
        out[f"ts_diff_{w}"] = out[f"ts_pct_{w}"] - out[f"ts_pct_opponent_{w}"]
        # the ratios are lagged already, so their spread includes the row itself
        series = np.column_stack([out[f"{c}_{w}"] for c in RATIO_STD])
        spread = Sums(series, first, include_current=True).deviation(w, min_games(w, impute))
        for j, c in enumerate(RATIO_STD):
            out[f"{c}_{w}_std"] = spread[:, j]
    for name, (recent, season) in vs_average_names(list(out), *windows).items():
        out[name] = divide(out[recent], np.where(np.abs(out[season]) > NEAR_ZERO, out[season], np.nan))
    return out


def team_columns(windows=WINDOWS) -> list[str]:
    """Names of the numeric team features, in order."""
    nothing = np.empty((0, len(TEAM_STATS)))
    return list(_team_columns(nothing, np.empty(0, np.int64), np.empty(0), windows, True))


def team_form(rows: DataFrame, windows=WINDOWS, impute: bool = True, line: Timeline = TEAM_SEASON,
              size: int | None = None, also: tuple[str, ...] = (), columns: list[str] | None = None,
              finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """All pre-game team features, one row per (game, team); ``rows`` come from ``derived_box``, and keep the columns ``also``.

    With ``columns``, only these of the features are returned. ``finish`` is applied to their values.
    """
    carried = ["game_id", "date", *line.keys, *also, "is_win", "has_won_last_game",
               "current_winning_streak", "current_losing_streak"]
    rows = streaks(rows, line).select(*carried, ORDINAL, TOTAL, *TEAM_STATS)
    windows = tuple(windows)

    names = [c for c in team_columns(windows) if columns is None or c in columns]

    def compute(x, first, age):
        return _team_columns(x, first, age, windows, impute)

    return _block_apply(placed(rows, line, windows, spans=windows, reach=2, size=size), line, carried, TEAM_STATS, compute, names, finish=finish)


def stats_of(columns: list[str], stats: list[str] | None = None, windows=WINDOWS) -> list[str]:
    """The stats that the player features ``columns`` are made of."""
    return [c for c in stats or PLAYER_STATS if any(n in columns for n in _basic_names([c], windows))]


def player_form(rows: DataFrame, windows=WINDOWS, impute: bool = True, line: Timeline = PLAYER_SEASON,
                size: int | None = None, stats: list[str] | None = None, columns: list[str] | None = None, latest: bool = False,
                derived: tuple[list[str], Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]] | None = None,
                keep: tuple[str, ...] = tuple(PLAYER_KEYS)) -> DataFrame:
    """All pre-game player features, one row per (game, player). Mean minutes always need one game only.

    With ``columns``, only these of the features are computed and returned. With ``latest``, only rows among which every entity's last one is:
    one for each entity or block. With ``derived``, names and a function from the features to these, the derived values (doubles) are returned in the
    features' place. ``keep`` has the keys to return. Entities of at most one block need no ordinals: they go to their task in one shuffle. The others, if
    there are any, are cut into blocks.
    """
    stats, windows = list(stats or PLAYER_STATS), tuple(windows)
    names = [n for n in _basic_names(stats, windows) if columns is None or n in columns]
    stats = stats_of(names, stats, windows)
    carried = list(keep)

    def compute(x, first, age):
        found = _basic_columns(x, first, age, stats, windows, impute, {"mp"}, names)
        return derived[1](found) if derived else found

    def formed(some: DataFrame) -> DataFrame:
        return _block_apply(some, line, carried, stats, compute, derived[0] if derived else names, latest)

    slim = rows.select(*PLAYER_KEYS, *stats)
    size = size or block_size(list(windows))
    long = written(long_entities(slim, line, size), "long")
    if long.isEmpty():
        return formed(slim)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in line.keys]
    whole, cut = (slim.join(long, same, how) for how in ("left_anti", "left_semi"))
    return formed(whole).unionByName(formed(placed(cut, line, windows, spans=windows, size=size)))
