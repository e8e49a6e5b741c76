"""Scans, slices, sinks and landed pages."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.queries.base import query, rounded
from tipoff.session import new_path
from tipoff.sources import landed, tables


def _schedule(spark, sf_dir):
    """Schedule rows with a landed link for every game whose order key is odd."""
    url = F.when(F.col("game_id") % 2 == 1, F.concat(F.lit("/boxscores/"), F.col("game_id").cast("string"), F.lit(".html")))
    return fx.sched(spark, sf_dir).withColumn("game_url", F.coalesce(url, F.lit("")))


_URL = "case when game_id % 2 = 1 then '/boxscores/' || game_id || '.html' else '' end"


@query("s01_parquet_round_trip", with_sql("sched", "select game_id, date, home_team, season_id from sched where season_id >= 1998"))
def s01(spark, sf_dir):
    path = new_path(spark, "schedule")
    tables.write_by_season(fx.sched(spark, sf_dir), path)
    return tables.read_table(spark, path, ["game_id", "date", "home_team", "season_id"], F.col("season_id") >= 1998)


@query("s02_csv_round_trip", with_sql("pred", "select game_id, is_home_win, proba_a, proba_b, proba_c from pred"))
def s02(spark, sf_dir):
    path, rows = new_path(spark, "predictions"), fx.pred(spark, sf_dir)
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("s03_table_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderkey")
def s03(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                             F.col("o_orderstatus") == "O", "o_orderkey")


@query("s04_distinct_keys", with_sql("sched", "select distinct game_id from sched where season_id = 1999"))
def s04(spark, sf_dir):
    return tables.distinct_keys(fx.sched(spark, sf_dir), "game_id", 1999)


@query("s05_distinct_where_in", """select distinct l_suppkey from lineitem
    where l_suppkey is not null and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def s05(spark, sf_dir):
    urgent = fx.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return tables.distinct_where_in(fx.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", urgent)


@query("s06_month_slice", with_sql("sched", "select game_id, date from sched where date >= date '1996-12-01' and date < date '1997-01-01'"))
def s06(spark, sf_dir):
    return tables.month_slice(fx.sched(spark, sf_dir), datetime.date(1996, 12, 17)).select("game_id", "date")


@query("s07_latest_slice", with_sql("sched box", """select game_id, pts_home, pts_guest from box where game_id in
    (select game_id from sched where season_id = (select max(season_id) from sched))"""))
def s07(spark, sf_dir):
    _, rows = tables.latest_slice(fx.sched(spark, sf_dir), fx.box(spark, sf_dir), "season_id", "game_id")
    return rows.select("game_id", "pts_home", "pts_guest")


@query("s08_latest_season", with_sql("sched", "select max(season_id) as season_id from sched"))
def s08(spark, sf_dir):
    return tables.latest_season(fx.sched(spark, sf_dir))


@query("s09_append_new", with_sql("box", "select game_id, pts_home, pts_guest from box"))
def s09(spark, sf_dir):
    path = new_path(spark, "results")
    landed_rows = fx.box(spark, sf_dir).select("game_id", "pts_home", "pts_guest")
    tables.replace_table(landed_rows.where("pts_home > pts_guest"), path)
    for _ in range(2):  # the second run finds nothing to add
        tables.append_new(landed_rows, path, ["game_id"])
    return spark.read.parquet(path)


@query("s10_upsert", with_sql("sched", f"""select game_id, date, home_team,
    case when season_id >= 1999 then {_URL} else 'stored' end as game_url from sched"""))
def s10(spark, sf_dir):
    rows, path = _schedule(spark, sf_dir), new_path(spark, "schedule")
    rows.where("season_id <= 1999").withColumn("game_url", F.lit("stored")).write.partitionBy("season_id").parquet(path)
    tables.upsert_partitions(rows.where("season_id >= 1999"), path, ["game_id"], "season_id")
    return spark.read.parquet(path).select("game_id", "date", "home_team", "game_url")


@query("s11_changed_rows", with_sql("sched", f"""select game_id, {_URL} as game_url from sched
    where season_id > 1999 or (season_id <= 1999 and game_id % 2 = 1)"""))
def s11(spark, sf_dir):
    rows = _schedule(spark, sf_dir)
    stored = rows.where("season_id <= 1999").withColumn("game_url", F.lit(""))
    return tables.changed_rows(rows, stored).select("game_id", "game_url")


@query("s12_replace_table", with_sql("box", "select game_id, pf_home, pf_guest from box"))
def s12(spark, sf_dir):
    rows = fx.box(spark, sf_dir).select("game_id", "pf_home", "pf_guest")
    csv, path = new_path(spark, "landed-csv"), new_path(spark, "attributions")
    tables.write_csv(rows, csv)
    tables.replace_table(rows.where("pf_home > 3"), path)
    tables.replace_table(tables.read_csv(spark, csv, rows.schema), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("s13_missing_work", with_sql("sched box", """select s.game_id, t.game_id is null as needs_team, p.game_id is null as needs_player
    from sched s left join (select game_id from box where pts_home > pts_guest) t on t.game_id = s.game_id
    left join (select distinct l_orderkey as game_id from lineitem where l_quantity > 25) p on p.game_id = s.game_id
    where s.game_id % 2 = 1 and (t.game_id is null or p.game_id is null)"""))
def s13(spark, sf_dir):
    team = fx.box(spark, sf_dir).where("pts_home > pts_guest")
    player = fx.table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("game_id"))
    return tables.missing_work(_schedule(spark, sf_dir), team, player).select("game_id", "needs_team", "needs_player")


@query("s14_page_links", r"""select page_id, href, regexp_extract(href, '/teams/([^/]*)', 1) as team_abbrev,
    split_part(regexp_extract(href, '([^/]*)$', 1), '.html', 1) as player_id
    from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages) x""")
def s14(spark, sf_dir):
    links = landed.links(fx.table(spark, sf_dir, "pages"))
    return links.select("page_id", "href", landed.team_abbrev(F.col("href")).alias("team_abbrev"),
                        landed.player_id(F.col("href")).alias("player_id"))


_SHOWN = ["mp", "pts", "fg", "plus_minus"]


def _pages(spark, sf_dir):
    """Every played game as a landed page with one stat table, built from the player box scores."""
    player = F.concat(*[
        F.lit('<tr class="p"><th data-append-csv="'), F.col("player_id").cast("string"), F.lit('" scope="row"><a href="/players/'),
        F.col("player_id").cast("string"), F.lit('.html">Player '), F.col("player_id").cast("string"), F.lit("</a></th>"),
        F.concat(F.lit('<td data-stat="mp">'), F.col("mp").cast("bigint").cast("string"), F.lit(":30</td>")),
        *[F.concat(F.lit(f'<td data-stat="{s}"> '), F.col(s).cast("string"), F.lit("</td>")) for s in _SHOWN[1:]],
        F.lit("</tr>")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("player_id", player.alias("h")))), lambda x: x.h), "\n")
    head = '<thead><tr><th>Basic</th></tr><tr><th data-stat="player">Starters</th>' + "".join(
        f'<th class="x" data-stat="{s}">{s}</th>' for s in _SHOWN) + "</tr></thead>"
    foot = F.concat(*[F.lit('<tfoot><tr><th data-stat="player">Team Totals</th><td>240</td>'),
                      *[F.concat(F.lit("<td>"), F.sum(s).cast("string"), F.lit("</td>")) for s in _SHOWN[1:]],
                      F.lit("</tr></tfoot>")])
    html = F.concat(F.lit(f'<html><div><table id="box-game-basic" class="stats">{head}<tbody>'), body,
                    F.lit('<tr class="thead"><th>Reserves</th><th>MP</th></tr></tbody>'), foot, F.lit("</table></div></html>"))
    return fx.player_box(spark, sf_dir).groupBy(F.col("game_id").alias("page_id")).agg(html.alias("html"))


@query("s15_stat_tables", with_sql("player_box", """select game_id as page_id, cast(player_id as varchar) as player_id,
    'Player ' || player_id as player_name, mp + 0.5 as mp, pts, fg, plus_minus from player_box"""))
def s15(spark, sf_dir):
    rows = landed.table_rows(_pages(spark, sf_dir), "box-game-basic")
    return rounded(landed.typed_players(landed.wide_stats(rows, "tbody", _SHOWN), _SHOWN))
