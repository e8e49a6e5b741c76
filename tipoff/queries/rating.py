"""E01-E03. A rating depends on the whole earlier history of its league, so the SQL walks all leagues at once, one game a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.operators import ratings, relational
from tipoff.queries.base import query, rounded, sql_round

#: Customers of a league: leagues grow in number with the data, their games do not.
LEAGUE_KEYS = 500


def league_games(spark, sf_dir):
    """Games with the league of their customer; a team has one rating in each league."""
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.floor(F.col("o_custkey") / LEAGUE_KEYS).cast("bigint").alias("league"))
    return fx.games(spark, sf_dir).join(orders.hint("merge"), "game_id").select(
        "league", "game_id", "date", "season_id", "home_team", "guest_team", "pts_home", "pts_guest")


def _walk(line: str, carry: str) -> str:
    """All rated games. ``line``: what is walked by itself; ``carry``: a rating at the start of the next season."""
    return with_sql("games", f""", ordered as materialized (
        select {line} as line, cast(floor(o_custkey / {LEAGUE_KEYS}) as bigint) as league, g.season_id, g.date, g.game_id,
            g.home_team, g.guest_team, cast(g.pts_home as double) as ph, cast(g.pts_guest as double) as pg,
            row_number() over (partition by {line} order by g.season_id, g.date, g.game_id) as n
        from games g join orders on o_orderkey = g.game_id where g.pts_home is not null),
    walk as (
        select line, 0::bigint as n, null::int as season, list_transform(range(25), lambda i: null::double) as r, null::bigint as league,
            null::bigint as game_id, null::date as date, null::bigint as home, null::bigint as guest,
            null::double as h0, null::double as h1, null::double as g0, null::double as g1
        from (select distinct line from ordered)
        union all
        select line, n, season_id, list_transform(b, lambda x, i: case i when home + 1 then h0 + gain when guest + 1 then g0 - gain else x end),
            league, game_id, date, home, guest, h0, h0 + gain, g0, g0 - gain
        from (select *, 20 * (power(abs(ph - pg) + 3, 0.8e0) / (7.5e0 + 0.006e0 *
                case when (edge > 0 and ph < pg) or (edge < 0 and ph > pg) then -abs(edge) else abs(edge) end))
                * ((case when ph > pg then 1e0 else 0e0 end) - 1 / (1 + power(10e0, -edge / 400))) as gain
            from (select *, h0 + 100 - g0 as edge
                from (select *, coalesce(b[home + 1], 1500e0) as h0, coalesce(b[guest + 1], 1500e0) as g0
                    from (select o.line, o.n, o.season_id, o.league, o.game_id, o.date, cast(o.home_team as bigint) as home,
                            cast(o.guest_team as bigint) as guest, o.ph, o.pg,
                            case when o.season_id = w.season then w.r
                                 when o.season_id = w.season + 1 then list_transform(w.r, lambda x: {carry})
                                 else list_transform(w.r, lambda x: null::double) end as b
                        from walk w join ordered o on o.line = w.line and o.n = w.n + 1) s1) s2) s3) s4),
    rated as (
        select league, game_id, date, season as season_id, home as team_id, h0 as elo_before, h1 as elo_after from walk where n > 0
        union all select league, game_id, date, season, guest, g0, g1 from walk where n > 0) """).replace("with ", "with recursive ", 1)


_LEAGUE = f"floor(o_custkey / {LEAGUE_KEYS})"
_SHOWN = f"league, game_id, date, season_id, cast(team_id as int) as team_id, {sql_round('elo_before', 'elo_before')}, {sql_round('elo_after', 'elo_after')}"
_CARRIED = _walk(_LEAGUE, "0.75e0 * x + 0.25e0 * 1505")


@query("e01_elo_season", _walk(f"{_LEAGUE} * 10000 + g.season_id", "null::double") + f"select {_SHOWN} from rated")
def e01(spark, sf_dir):
    return rounded(ratings.elo(league_games(spark, sf_dir), carry_over=False))


@query("e02_elo_carry_over", _CARRIED + f"select {_SHOWN} from rated")
def e02(spark, sf_dir):
    return rounded(ratings.elo(league_games(spark, sf_dir)))


@query("e03_elo_update", _CARRIED + f"""select sha256(concat(game_id, '_', team_id)) as id, {_SHOWN} from rated
    where season_id = (select max(season_id) from games where pts_home is not null) and date >= date '2001-04-01'""")
def e03(spark, sf_dir):
    """Games of the newest season's second half are rated on top of what is stored."""
    games = league_games(spark, sf_dir)
    known = ratings.elo(games).where("date < date '2001-04-01'")
    return rounded(ratings.elo_update(games.where(F.col("pts_home").isNotNull()), known))


@query("j10_elo_as_of", _CARRIED + f""", side as (
        select g.game_id, cast({_LEAGUE} as bigint) as league, g.date, g.home_team as team_id from games g join orders on o_orderkey = g.game_id
        union all select g.game_id, cast({_LEAGUE} as bigint), g.date, g.guest_team from games g join orders on o_orderkey = g.game_id),
    daily as (select league, team_id, date, max_by(elo_after, game_id) as elo_after, max(game_id) as seen_in from rated group by league, team_id, date)
    select side.game_id, side.league, side.date, cast(side.team_id as int) as team_id, {sql_round('elo_after', 'elo_after')}, seen_in
    from side asof left join daily on daily.league = side.league and daily.team_id = side.team_id and daily.date < side.date""")
def j10_elo(spark, sf_dir):
    """Every game's teams, played or not, with their rating after their last game before that day."""
    games = league_games(spark, sf_dir)
    sides = [games.select("game_id", "league", "date", F.col(f"{side}_team").alias("team_id")) for side in ("home", "guest")]
    rated = ratings.elo(games).select("league", "team_id", "date", "elo_after", "game_id", F.col("game_id").alias("seen_in"))
    return rounded(relational.as_of(sides[0].unionByName(sides[1]), rated, ["league", "team_id"], "date", ["elo_after", "seen_in"], ("game_id",), same_instant=False))
