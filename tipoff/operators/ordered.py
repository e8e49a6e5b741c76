"""Time-ordered computation that never puts one entity into one task.

A plain ``Window.partitionBy(team).orderBy(date)`` sorts all rows of a team in a single task, which fails
once a few teams hold most of the rows. Two building blocks replace it:

``running``  exclusive running sums and last-known values. Rows are windowed inside a *chunk* of the
             entity's time line (one date); the chunk totals, one row per entity and date, are
             accumulated over the dates; the two parts are added.
``blocks``   bounded look-back. Rows are cut by ordinal into blocks of a fixed number of rows and each
             block is preceded by copies of the rows it looks back to (its halo). Every window task then
             holds at most ``size + halo`` rows, whatever the size of the entity.

``numbered`` and ``cumulative``  places and running sums in one order over the whole table. The rows are dealt out by ranges of the
             order, whose split points come from the data; each range is numbered on its own, and what the ranges before it hold
             is added. One date with most of the rows is spread over many ranges.

All are exact. Entities smaller than a block are not copied at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tipoff.session import written

UNBOUNDED = Window.unboundedPreceding
ORDINAL, TOTAL, BLOCK, HOME, PLACE = "ordinal", "entity_rows", "__block", "__home", "__place"
FIRST, RANGE, TIE, _IN_RANGE = "__first", "__range", "__tie", (1 << 33) - 1


@dataclass(frozen=True)
class Timeline:
    """Entity ``keys``; the time line is ordered by ``chunk`` and, inside a chunk, by ``order``."""

    keys: tuple[str, ...]
    chunk: str = "date"
    order: tuple[str, ...] = ("game_id",)

    def by(self, *keys: str) -> "Timeline":
        return Timeline(tuple(keys), self.chunk, self.order)


TEAM_SEASON = Timeline(("season_id", "team"))
PLAYER_SEASON = Timeline(("season_id", "player_id"))


def running(
    df: DataFrame,
    line: Timeline,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, for every row, values of the rows strictly before it on its entity's time line.

    ``sums``   name -> expression, summed over the earlier rows (0 when there are none)
    ``lasts``  name -> expression, its latest non-NULL value among the earlier rows
    ``totals`` name -> expression, summed over the whole entity

    Rows with a NULL key or chunk stay: NULL is a key like any other, and a NULL chunk comes before all others.
    """
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    inside = Window.partitionBy(*line.keys, line.chunk).orderBy(FIRST, *line.order).rowsBetween(UNBOUNDED, -1)
    ticket = F.struct(*line.order)

    rows = df.select(
        "*", F.lit(1).alias(FIRST),
        *[e.alias(f"__e_{n}") for n, e in (*sums.items(), *lasts.items())],
    )
    per_chunk = df.groupBy(*line.keys, line.chunk).agg(
        *[F.sum(e).alias(f"__c_{n}") for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), ticket)).alias(f"__c_{n}") for n, e in lasts.items()],
        *[F.sum(e).alias(f"__t_{n}") for n, e in totals.items()],
        F.count(F.lit(1)).alias("__rows"),
    )
    earlier = Window.partitionBy(*line.keys).orderBy(line.chunk).rowsBetween(UNBOUNDED, -1)
    whole = Window.partitionBy(*line.keys)
    offsets = per_chunk.select(
        *line.keys, line.chunk, F.lit(0).alias(FIRST),
        *[F.sum(f"__c_{n}").over(earlier).alias(f"__off_{n}") for n in sums],
        *[F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__off_{n}") for n in lasts],
        *[F.sum(f"__t_{n}").over(whole).alias(f"__tot_{n}") for n in totals],
    )
    # a chunk's offset goes ahead of its rows in one window: NULL keys need no join, and the keys' partitioning is kept for the next step
    both = rows.unionByName(offsets, allowMissingColumns=True)
    found = both.select(
        "*",
        *[F.sum(f"__e_{n}").over(inside).alias(f"__in_{n}") for n in sums],
        *[F.last(f"__e_{n}", ignorenulls=True).over(inside).alias(f"__in_{n}") for n in lasts],
        *[F.first(f"__off_{n}").over(inside).alias(f"__at_{n}") for n in (*sums, *lasts)],
        *[F.first(f"__tot_{n}").over(inside).alias(f"__all_{n}") for n in totals],
    ).where(F.col(FIRST) == 1)
    zero = F.lit(0)
    return found.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__in_{n}"), zero) + F.coalesce(F.col(f"__at_{n}"), zero)).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__in_{n}"), F.col(f"__at_{n}")).alias(n) for n in lasts],
        *[F.col(f"__all_{n}").alias(n) for n in totals],
    )


def with_ordinal(df: DataFrame, line: Timeline, **sums: Column) -> DataFrame:
    """Add the 0-based position on the entity's time line, the entity's row count and further running sums."""
    one = F.lit(1)
    return running(df, line, sums={ORDINAL: one, **sums}, totals={TOTAL: one})


def ranged(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows dealt out by ranges of ``order`` and sorted in each, with the range and the 0-based place in it, as a written table.

    Rows that are equal in all of ``order`` go on in the order in which they were read, and may be split between ranges.
    """
    dealt = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*order, TIE).sortWithinPartitions(*order, TIE)
    return written(dealt.drop(TIE).select(
        "*", F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_RANGE)).alias(PLACE)), "ranges")


def numbered(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based position of every row in ``order`` among the rows with the same ``by``, and the number of those rows.

    NULL comes first, and is a value like others in ``by``. Nothing larger than a range is in one task.
    """
    rows = ranged(df, (*by, *order))
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy(RANGE).rowsBetween(UNBOUNDED, -1)), F.lit(0))
    starts = sizes.select(RANGE, before.alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    placed = rows.join(F.broadcast(starts), RANGE).withColumn("__at", F.col("__start") + F.col(PLACE))
    if not by:
        return placed.select(*df.columns, F.col("__at").alias(ORDINAL), F.col("__all").alias(TOTAL))
    # the groups lie one after another, so a place in the group is the distance to the group's first row
    groups = placed.groupBy(F.struct(*by).alias("__by")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias(TOTAL))
    return placed.withColumn("__by", F.struct(*by)).join(groups, "__by").select(
        *df.columns, (F.col("__at") - F.col("__first")).alias(ORDINAL), TOTAL)


def cumulative(df: DataFrame, order: tuple[str, ...], sums: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
               by: tuple[str, ...] = (), lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add values of the rows strictly before each one in ``order`` among those with the same ``by``: sums, latest non-NULL values
    (``lasts``), and sums over all of these rows (``totals``)."""
    sums, totals, lasts = sums or {}, totals or {}, lasts or {}
    rows = ranged(df, (*by, *order)).withColumn("__by", F.struct(F.lit(0).alias("k"), *by))
    inside = Window.partitionBy(RANGE, "__by").orderBy(PLACE).rowsBetween(UNBOUNDED, -1)
    parts = rows.groupBy("__by", RANGE).agg(*[F.sum(e).alias(f"__c_{n}") for n, e in sums.items()],
                                            *[F.max_by(e, F.when(e.isNotNull(), F.col(PLACE))).alias(f"__c_{n}") for n, e in lasts.items()],
                                            *[F.sum(e).alias(f"__t_{n}") for n, e in totals.items()],
                                            F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__by")  # a row for each range
    earlier = whole.orderBy(RANGE).rowsBetween(UNBOUNDED, -1)
    offsets = parts.select("__by", RANGE, *[F.sum(f"__c_{n}").over(earlier).alias(f"__off_{n}") for n in sums],
                           *[F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__off_{n}") for n in lasts],
                           *[F.sum(f"__t_{n}").over(whole).alias(f"__tot_{n}") for n in totals])
    within = rows.select("*", *[F.sum(e).over(inside).alias(f"__in_{n}") for n, e in sums.items()],
                         *[F.last(e, ignorenulls=True).over(inside).alias(f"__in_{n}") for n, e in lasts.items()])
    zero = F.lit(0)
    return within.join(offsets, [RANGE, "__by"]).select(
        *df.columns,
        *[(F.coalesce(F.col(f"__in_{n}"), zero) + F.coalesce(F.col(f"__off_{n}"), zero)).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__in_{n}"), F.col(f"__off_{n}")).alias(n) for n in lasts],
        *[F.col(f"__tot_{n}").alias(n) for n in totals])


def blocks(df: DataFrame, halo: int, size: int) -> DataFrame:
    """Spread rows that carry ``ordinal`` and ``entity_rows`` over blocks, each with its halo."""
    home = F.expr(f"{ORDINAL} div {size}")
    last_needed = F.least(F.expr(f"({ORDINAL} + {halo}) div {size}"), F.expr(f"({TOTAL} - 1) div {size}"))
    return df.select("*", home.alias(HOME), F.explode(F.sequence(home, last_needed)).alias(BLOCK))


def long_entities(df: DataFrame, line: Timeline, size: int) -> DataFrame:
    """The keys, as ``__key``, of the entities with more than ``size`` rows: at most one for so many rows."""
    sizes = df.groupBy(*[F.col(k).alias(f"__{k}") for k in line.keys]).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.where(F.col("__n") > size).drop("__n")


def block_window(line: Timeline) -> WindowSpec:
    return Window.partitionBy(*line.keys, BLOCK).orderBy(ORDINAL)


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies again."""
    return df.where(F.col(BLOCK) == F.col(HOME)).drop(BLOCK, HOME)


def ewm_halo(span: float) -> int:
    """Rows after which an exponential weight of this span falls below double precision."""
    return math.ceil(53 * math.log(2) / -math.log(ewm_keep(span)))


def ewm_keep(span: float) -> float:
    return 1 - 2 / (span + 1)


def block_size(spans: list[float], wanted: int = 2048) -> int:
    """Largest block for which ``keep ** -size`` of every span stays far inside the double range."""
    return min([wanted] + [int(600 / -math.log(ewm_keep(s))) for s in spans])
