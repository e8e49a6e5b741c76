"""Competition-shaped inputs derived from the TPC-H-like driver tables (FIXTURES.md, part 2).

Each function reads whole tables. Customers' nations host, suppliers are players, orders are games,
and an order without line items is a game that has not been played yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.functions.scalar import ratio

#: With ``leagues``, a league is made of so many customers and players, so leagues grow in number with the data and squads do not.
LEAGUE_CUSTOMERS, LEAGUE_PLAYERS, LEAGUE_TEAMS = 15_000, 1_000, 25

BOX_STATS = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "ast", "stl", "blk", "tov", "pf"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_stats() -> dict[str, Column]:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    q = F.floor("l_quantity").cast("bigint")
    return {
        "fg": 3 + part % 4, "fga": 6 + part % 4 + supp % 4, "fg3": 1 + part % 2, "fg3a": 2 + part % 2 + supp % 3,
        "ft": q % 3, "fta": q % 3 + supp % 2, "orb": part % 3, "drb": 2 + supp % 3, "ast": 1 + part % 3,
        "stl": supp % 2, "blk": part % 2, "tov": 1 + q % 2, "pf": q % 4,
    }


def _league_start(key: Column, size: int) -> Column:
    """Number of the first team in the league that a key, from 0 on, falls into."""
    return LEAGUE_TEAMS * F.floor(key / size)


def sched(spark: SparkSession, sf_dir: str, leagues: bool = False) -> DataFrame:
    """With ``leagues``, every league has teams of its own; below 15,000 customers there is one."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    host = F.col("c_nationkey")
    first = _league_start(F.col("c_custkey"), LEAGUE_CUSTOMERS) if leagues else F.lit(0)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.year("o_orderdate").cast("int").alias("season_id"),
        (first + host).cast(customer.schema["c_nationkey"].dataType).alias("home_team"),
        (first + (host + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("guest_team"),
        host.alias("arena"),
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per played game: integer counting stats of both sides plus the three rates."""
    sums = []
    for side, odd in (("home", 1), ("guest", 0)):
        for name, value in _line_stats().items():
            own = F.when(F.col("l_linenumber") % 2 == odd, value).otherwise(F.lit(0))
            sums.append(F.sum(own).cast("bigint").alias(f"{name}_{side}"))
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(*sums)
    sides = ("home", "guest")
    counted = raw.select(
        "*",
        *[(F.col(f"orb_{s}") + F.col(f"drb_{s}")).alias(f"trb_{s}") for s in sides],
        *[(2 * F.col(f"fg_{s}") + F.col(f"fg3_{s}") + F.col(f"ft_{s}")).alias(f"pts_{s}") for s in sides],
    )

    def shots(s):
        return F.col(f"fga_{s}") + 0.44 * F.col(f"fta_{s}")

    off = {s: ratio(100.0 * F.col(f"pts_{s}"), shots(s) - F.col(f"orb_{s}") + F.col(f"tov_{s}")) for s in sides}
    rates = []
    for s, other in (("home", "guest"), ("guest", "home")):
        rates += [off[s].alias(f"off_rtg_{s}"), off[other].alias(f"def_rtg_{s}"),
                  ratio(100.0 * F.col(f"tov_{s}"), shots(s) + F.col(f"tov_{s}")).alias(f"tov_pct_{s}")]
    return counted.select("*", *rates)


def games(spark: SparkSession, sf_dir: str, leagues: bool = False) -> DataFrame:
    """Schedule left join box score; ``is_home_win`` is NULL while a game is unplayed."""
    from tipoff.functions.scalar import home_win

    joined = sched(spark, sf_dir, leagues).join(box(spark, sf_dir), "game_id", "left")
    return joined.select("*", home_win("pts_home", "pts_guest").alias("is_home_win"))


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("arena"),
        (-60 + (key * 37) % 120).cast("double").alias("latitude"),
        (-180 + (key * 53) % 360).cast("double").alias("longitude"),
    )


def playoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").cast("int")
    return table(spark, sf_dir, "orders").select(year.alias("season_id")).distinct().select(
        "season_id", F.make_date("season_id", F.lit(9), F.lit(1)).alias("playoff_start"))


def season_games(spark: SparkSession, sf_dir: str, leagues: bool = False) -> DataFrame:
    """Games with venue coordinates and the playoff flag: the input of the schedule features."""
    from tipoff.operators.relational import with_venue_and_phase

    return with_venue_and_phase(games(spark, sf_dir, leagues), location(spark, sf_dir), playoffs(spark, sf_dir))


def player_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (game, player). All stats are whole numbers held as doubles."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    stats = {name: F.sum(value) for name, value in _line_stats().items()}
    stats["trb"] = F.sum(part % 3 + 2 + supp % 3)
    stats["mp"] = F.sum(5 + part % 30)
    stats["pts"] = F.sum("l_quantity")
    stats["plus_minus"] = F.sum(part % 21) - 10
    stats["game_score"] = F.sum(part % 25) - 2
    stats["off_rtg"] = 90 + F.sum(part % 40)
    stats["def_rtg"] = 95 + F.sum(supp % 30)
    stats["bpm"] = F.sum(part % 13) - 6
    lines, fixtures = table(spark, sf_dir, "lineitem"), sched(spark, sf_dir)
    side_team = F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team")).otherwise(F.col("guest_team"))
    return (
        lines.join(fixtures, lines.l_orderkey == fixtures.game_id)
        .groupBy("game_id", "date", "season_id", F.col("l_suppkey").alias("player_id"))
        .agg(F.min(side_team).alias("team_id"), *[v.cast("double").alias(k) for k, v in stats.items()])
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as players of their nation's team in their league."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("player_id"), F.col("s_name").alias("player_name"),
        (_league_start(key, LEAGUE_PLAYERS) + F.col("s_nationkey")).cast("bigint").alias("team_id"),
        F.when(key % 10 == 0, F.lit("Day-To-Day")).when(key % 10 == 1, F.lit("Out for season")).alias("injury"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored games with three invented probabilities, for the evaluation operators."""
    g = F.col("game_id")
    return box(spark, sf_dir).select(
        "game_id", (F.col("pts_home") > F.col("pts_guest")).alias("is_home_win"),
        (((g * 7919) % 1000) / 1000.0).alias("proba_a"),
        (((g * 104729 + F.col("pts_home")) % 1000) / 1000.0).alias("proba_b"),
        (((F.col("pts_home") * 13 + F.col("pts_guest") * 7) % 997) / 997.0).alias("proba_c"),
    )


# ---------------------------------------------------------------------------
# The same recipes as SQL text, for the oracle
# ---------------------------------------------------------------------------

_SQL_LINE = {
    "fg": "3 + l_partkey % 4", "fga": "6 + l_partkey % 4 + l_suppkey % 4", "fg3": "1 + l_partkey % 2",
    "fg3a": "2 + l_partkey % 2 + l_suppkey % 3", "ft": "cast(floor(l_quantity) as bigint) % 3",
    "fta": "cast(floor(l_quantity) as bigint) % 3 + l_suppkey % 2", "orb": "l_partkey % 3",
    "drb": "2 + l_suppkey % 3", "ast": "1 + l_partkey % 3", "stl": "l_suppkey % 2", "blk": "l_partkey % 2",
    "tov": "1 + cast(floor(l_quantity) as bigint) % 2", "pf": "cast(floor(l_quantity) as bigint) % 4",
}


def _sql_box() -> str:
    cols = [
        f"cast(sum(case when l_linenumber % 2 = {odd} then {e} else 0 end) as bigint) as {name}_{side}"
        for side, odd in (("home", 1), ("guest", 0)) for name, e in _SQL_LINE.items()
    ]
    sides = ("home", "guest")
    derived = [f"orb_{s} + drb_{s} as trb_{s}" for s in sides]
    derived += [f"2*fg_{s} + fg3_{s} + ft_{s} as pts_{s}" for s in sides]

    def off(s):
        return f"100.0e0*pts_{s} / nullif(fga_{s} + 0.44e0*fta_{s} - orb_{s} + tov_{s}, 0)"

    rates = []
    for s, o in (("home", "guest"), ("guest", "home")):
        rates += [f"{off(s)} as off_rtg_{s}", f"{off(o)} as def_rtg_{s}",
                  f"100.0e0*tov_{s} / nullif(fga_{s} + 0.44e0*fta_{s} + tov_{s}, 0) as tov_pct_{s}"]
    return (
        f"select *, {', '.join(rates)} from (select *, {', '.join(derived)} from "
        f"(select l_orderkey as game_id, {', '.join(cols)} from lineitem group by l_orderkey) r) c"
    )


def _sql_player_box() -> str:
    stats = {k: f"sum({e})" for k, e in _SQL_LINE.items()}
    stats.update(
        trb="sum(l_partkey % 3 + 2 + l_suppkey % 3)", mp="sum(5 + l_partkey % 30)", pts="sum(l_quantity)",
        plus_minus="sum(l_partkey % 21) - 10", game_score="sum(l_partkey % 25) - 2",
        off_rtg="90 + sum(l_partkey % 40)", def_rtg="95 + sum(l_suppkey % 30)", bpm="sum(l_partkey % 13) - 6",
    )
    cols = ", ".join(f"cast({e} as double) as {k}" for k, e in stats.items())
    return (
        "select game_id, date, season_id, l_suppkey as player_id, "
        "min(case when l_linenumber % 2 = 1 then home_team else guest_team end) as team_id, "
        f"{cols} from lineitem join sched on game_id = l_orderkey group by game_id, date, season_id, l_suppkey"
    )


SQL = {
    "sched": """select o_orderkey as game_id, cast(o_orderdate as date) as date,
        cast(year(o_orderdate) as int) as season_id, c_nationkey as home_team,
        cast((c_nationkey + 1 + o_orderkey % 24) % 25 as int) as guest_team, c_nationkey as arena
        from orders join customer on o_custkey = c_custkey""",
    "box": _sql_box(),
    "games": """select s.*, b.* exclude (game_id), b.pts_home > b.pts_guest as is_home_win
        from sched s left join box b on s.game_id = b.game_id""",
    "location": """select n_nationkey as arena, cast(-60 + (n_nationkey * 37) % 120 as double) as latitude,
        cast(-180 + (n_nationkey * 53) % 360 as double) as longitude from nation""",
    "playoffs": """select distinct cast(year(o_orderdate) as int) as season_id,
        make_date(cast(year(o_orderdate) as int), 9, 1) as playoff_start from orders""",
    "season_games": """select g.*, l.latitude, l.longitude, g.date >= p.playoff_start as is_playoff_game
        from games g join location l on g.arena = l.arena join playoffs p on g.season_id = p.season_id""",
    "team_games": """select game_id, date, season_id, home_team as team, guest_team as opponent, 'home' as side,
        is_home_win as win from games union all
        select game_id, date, season_id, guest_team, home_team, 'guest', not is_home_win from games""",
    "player_box": _sql_player_box(),
    "league_games": f"""select g.* replace (cast({LEAGUE_TEAMS} * (o_custkey // {LEAGUE_CUSTOMERS}) + home_team as int) as home_team,
        cast({LEAGUE_TEAMS} * (o_custkey // {LEAGUE_CUSTOMERS}) + guest_team as int) as guest_team)
        from games g join orders on o_orderkey = game_id""",
    "roster": f"""select s_suppkey as player_id, s_name as player_name,
        cast({LEAGUE_TEAMS} * (s_suppkey // {LEAGUE_PLAYERS}) + s_nationkey as bigint) as team_id,
        case when s_suppkey % 10 = 0 then 'Day-To-Day' when s_suppkey % 10 = 1 then 'Out for season' end as injury
        from supplier""",
    "pred": """select game_id, pts_home > pts_guest as is_home_win,
        ((game_id * 7919) % 1000) / 1000.0e0 as proba_a,
        ((game_id * 104729 + pts_home) % 1000) / 1000.0e0 as proba_b,
        ((pts_home * 13 + pts_guest * 7) % 997) / 997.0e0 as proba_c from box""",
}

_NEEDS = {
    "games": ["sched", "box"], "league_games": ["games"], "season_games": ["games", "location", "playoffs"], "team_games": ["games"],
    "player_box": ["sched"], "pred": ["box"],
}


def with_sql(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} as ({SQL[n]})" for n in ordered] + [f"{n} as ({q})" for n, q in (extra or {}).items()]
    return f"with {', '.join(ctes)} {body}" if ctes else body
