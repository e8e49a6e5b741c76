"""J01-J10 joins, K01-K07 sort, limit and set operations, A10-A14 plain aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.operators import lineup, relational as R, views
from tipoff.operators.schedule import team_dates
from tipoff.queries.base import query, rounded
from tipoff.queries.windows import played_team_box, TB


@query("j01_star_join", with_sql("season_games", """select game_id, date, season_id, home_team, guest_team, pts_home,
    latitude, longitude, is_playoff_game from season_games where pts_home is not null"""))
def j01(spark, sf_dir):
    played = fx.sched(spark, sf_dir).join(fx.box(spark, sf_dir), "game_id")
    return R.with_venue_and_phase(played, fx.location(spark, sf_dir), fx.playoffs(spark, sf_dir)).select(
        "game_id", "date", "season_id", "home_team", "guest_team", "pts_home", "latitude", "longitude", "is_playoff_game")


@query("j02_schedule_left_box", with_sql("games", "select game_id, date, pts_home, pts_guest, is_home_win from games"))
def j02(spark, sf_dir):
    return fx.games(spark, sf_dir).select("game_id", "date", "pts_home", "pts_guest", "is_home_win")


@query("j03_role_join", with_sql("games", """select g.game_id, g.home_team, g.guest_team, h.pts as pts_home, h.ast as ast_home,
    a.pts as pts_guest, a.ast as ast_guest from games g left join tb h on h.game_id = g.game_id and h.team = g.home_team
    left join tb a on a.game_id = g.game_id and a.team = g.guest_team""", TB))
def j03(spark, sf_dir):
    features = played_team_box(spark, sf_dir).select("game_id", "team", "pts", "ast")
    schedule = fx.sched(spark, sf_dir).select("game_id", "home_team", "guest_team")
    return views.attach_roles(schedule, features)


@query("j04_remaining_games", with_sql("games", "select game_id, date, home_team, guest_team from games where pts_home is null"))
def j04(spark, sf_dir):
    return R.remaining(fx.sched(spark, sf_dir), fx.box(spark, sf_dir)).select("game_id", "date", "home_team", "guest_team")


@query("j05_semi_join", with_sql("games", """select game_id, player_id, mp from player_box
    where game_id in (select game_id from games where is_home_win and season_id = 1997)""",
    {"player_box": fx.SQL["player_box"]}))
def j05(spark, sf_dir):
    wins = fx.games(spark, sf_dir).where("is_home_win and season_id = 1997").select("game_id")
    return fx.player_box(spark, sf_dir).join(wins, "game_id", "left_semi").select("game_id", "player_id", "mp")


_NEXT = {
    "todo": "select * from games where pts_home is null",
    "n": """select team, first(game_id order by date, game_id) as game_id from
        (select game_id, date, home_team as team from todo union all select game_id, date, guest_team from todo) t group by team""",
}


@query("j06_upcoming_games", with_sql("games", """select t.game_id, t.date, t.home_team, t.guest_team from todo t
    join n h on h.team = t.home_team and h.game_id = t.game_id
    join n a on a.team = t.guest_team and a.game_id = t.game_id""", _NEXT))
def j06(spark, sf_dir):
    return R.upcoming_games(fx.sched(spark, sf_dir), fx.box(spark, sf_dir)).select("game_id", "date", "home_team", "guest_team")


@query("j07_natural_key_join", with_sql("player_box", """select game_id, player_name, mp, pts, bpm from
    (select game_id, player_id % 7 as player_name, case when player_id % 11 = 0 then null else mp end as mp, pts from player_box) b
    join (select game_id, player_id % 7 as player_name, case when player_id % 11 = 0 then null else mp end as mp, bpm from player_box) a
    using (game_id, player_name, mp)"""))
def j07(spark, sf_dir):
    box = fx.player_box(spark, sf_dir).select(
        "game_id", (F.col("player_id") % 7).alias("player_name"),
        F.when(F.col("player_id") % 11 != 0, F.col("mp")).alias("mp"), "pts", "bpm")
    joined = R.keyed_on_values(box.drop("bpm"), box.drop("pts"), ["game_id", "player_name", "mp"])
    return joined.select("game_id", "player_name", "mp", "pts", "bpm")


@query("j08_complement", with_sql("sched", """select game_id, date from sched where date < date '2000-01-01' and game_id not in
    (select game_id from (select game_id, row_number() over (order by date, game_id) as rn, count(*) over () as n
     from sched where date < date '2000-01-01') x where rn <= round_even(n * 0.85, 0))"""))
def j08(spark, sf_dir):
    from tipoff.ml.split import train_test

    return train_test(fx.sched(spark, sf_dir), "2000-01-01", 0.85).where("role = 'test'").select("game_id", "date")


_SCEN = {
    "d": "select team_id, count(*) as k from roster where injury like 'Day%' group by team_id",
    "sc": """select t.team_id, unnest(range(cast(pow(2, coalesce(k, 0)) as bigint))) as scenario_id
        from (select distinct team_id from roster where injury is null or injury like 'Day%') t left join d on d.team_id = t.team_id""",
}


@query("j09_scenario_pairs", with_sql("league_games roster", """select t.game_id, t.home_team, t.guest_team,
    h.scenario_id as scenario_id_home, a.scenario_id as scenario_id_guest from todo t
    join n nh on nh.team = t.home_team and nh.game_id = t.game_id join n na on na.team = t.guest_team and na.game_id = t.game_id
    join sc h on h.team_id = t.home_team join sc a on a.team_id = t.guest_team""",
    {**{k: v.replace("from games", "from league_games") for k, v in _NEXT.items()}, **_SCEN}))
def j09(spark, sf_dir):
    schedule = fx.sched(spark, sf_dir, leagues=True)
    coming = R.upcoming_games(schedule, fx.box(spark, sf_dir)).select("game_id", "home_team", "guest_team")
    return R.scenario_pairs(coming, lineup.scenario_ids(fx.roster(spark, sf_dir)))


@query("j10_latest_snapshot", with_sql("games", f"""select t.game_id, t.home_team, s.pts, s.game_id as seen_in from todo t
    join (select team, pts, game_id, row_number() over (partition by team order by date desc, game_id desc) as rn from tb) s
    on s.team = t.home_team and s.rn = 1""", {**TB, "todo": _NEXT["todo"]}))
def j10(spark, sf_dir):
    box = played_team_box(spark, sf_dir).select("team", "date", "game_id", "pts")
    latest = R.latest_per(box, ["team"], ["date", "game_id"], ["pts", "game_id"]).select(
        F.col("team").alias("home_team"), "pts", F.col("game_id").alias("seen_in"))
    todo = R.remaining(fx.sched(spark, sf_dir), fx.box(spark, sf_dir)).select("game_id", "home_team")
    return todo.join(latest, "home_team")


@query("j10_player_form_as_of", with_sql("player_box", """select b.player_id, b.game_id, b.date, s.m.g as seen_in, s.m.p as pts
    from (select player_id, game_id, date - 30 as date from player_box) b
    asof left join (select player_id, date, max(struct_pack(g := game_id, p := pts)) as m from player_box group by player_id, date) s
    on s.player_id = b.player_id and s.date <= b.date"""))
def j10_player(spark, sf_dir):
    """What was known of each player thirty days before each of their games."""
    box = fx.player_box(spark, sf_dir)
    instants = box.select("player_id", "game_id", F.date_sub("date", 30).alias("date"))
    known = box.select("player_id", "date", "pts", F.col("game_id").alias("seen_in"))
    return R.as_of(instants, known, ["player_id"], "date", ["seen_in", "pts"], ("seen_in", "pts"))


@query("k01_global_sort", with_sql("sched", "select game_id, date, home_team from sched order by date, home_team, game_id"))
def k01(spark, sf_dir):
    return fx.sched(spark, sf_dir).select("game_id", "date", "home_team").orderBy("date", "home_team", "game_id")


@query("k02_top_games", with_sql("box", "select game_id, pts_home + pts_guest as pts from box order by pts desc, game_id limit 10"))
def k02(spark, sf_dir):
    return fx.box(spark, sf_dir).select("game_id", (F.col("pts_home") + F.col("pts_guest")).alias("pts")).orderBy(
        F.desc("pts"), "game_id").limit(10)


@query("k03_least_values", with_sql("player_box", """select player_id, round(avg(bpm), 6) as importance from player_box
    group by player_id order by importance, player_id limit 5"""))
def k03(spark, sf_dir):
    means = fx.player_box(spark, sf_dir).groupBy("player_id").agg(F.round(F.avg("bpm"), 6).alias("importance"))
    return means.orderBy("importance", "player_id").limit(5)


@query("k04_union_all", with_sql("sched", """select game_id, home_team as team from sched
    union all select game_id, guest_team from sched"""))
def k04(spark, sf_dir):
    games = fx.sched(spark, sf_dir)
    home = games.select("game_id", F.col("home_team").alias("team"))
    return home.unionByName(games.select(F.col("guest_team").alias("team"), "game_id"))


@query("k05_key_difference", with_sql("sched box", "select game_id from sched except all select game_id from box"))
def k05(spark, sf_dir):
    return fx.sched(spark, sf_dir).select("game_id").exceptAll(fx.box(spark, sf_dir).select("game_id"))


@query("k06_unpivot_sides", with_sql("sched", """select game_id, 'home_team' as side, home_team as team from sched
    union all select game_id, 'guest_team', guest_team from sched"""))
def k06(spark, sf_dir):
    return views.home_guest_sides(fx.sched(spark, sf_dir))


@query("k07_keyed_concat", with_sql("box", """select game_id, pts_home, round(off_rtg_home, 6) as off_rtg_home, pts_guest,
    round(off_rtg_guest, 6) as off_rtg_guest from box"""))
def k07(spark, sf_dir):
    """Side by side by key: rows of a distributed table have no position to line up on."""
    box = fx.box(spark, sf_dir)
    parts = {s: box.select("game_id", f"pts_{s}", f"off_rtg_{s}") for s in ("home", "guest")}
    return rounded(parts["home"].join(parts["guest"], "game_id"))


@query("a10_scenario_mean", with_sql("pred", """select game_id % 500 as game_id, is_home_win, round(avg(proba_a) * (1 + 1e-11), 6) as proba_a,
    round(avg(proba_b) * (1 + 1e-11), 6) as proba_b from (select * from pred union all
    select game_id, null, proba_a, proba_b, proba_c from pred) x group by game_id % 500, is_home_win"""))
def a10(spark, sf_dir):
    """Scenarios of one game share (game, label); games still to come have a NULL label, which is a group too."""
    from tipoff.ml.scoring import scenario_mean

    scored = fx.pred(spark, sf_dir)
    coming = scored.withColumn("is_home_win", F.lit(None).cast("boolean"))
    rows = scored.unionByName(coming).withColumn("game_id", F.col("game_id") % 500)
    return rounded(scenario_mean(rows, ["game_id", "is_home_win"], ["proba_a", "proba_b"]), nudge=True)


@query("a11_first_last", with_sql("team_games", """select team, first(game_id order by date, game_id) as first_game,
    last(game_id order by date, game_id) as last_game from team_games group by team"""))
def a11(spark, sf_dir):
    rows = views.team_rows(fx.games(spark, sf_dir), ["game_id", "date"])
    when = F.struct("date", "game_id")
    return rows.groupBy("team").agg(
        F.min_by("game_id", when).alias("first_game"), F.max_by("game_id", when).alias("last_game"))


@query("a12_distinct_dates", with_sql("team_games", "select distinct season_id, team, date from team_games"))
def a12(spark, sf_dir):
    return team_dates(fx.games(spark, sf_dir))


_NUM = [f"{c}_{s}" for c in ("fg", "fga", "ft", "ast", "tov", "pf", "blk") for s in ("home", "guest")]


@query("a13_label_correlation", with_sql("games", "select * from (" + " union all ".join(
    f"select '{c}' as feature, round(corr({c}, cast(is_home_win as int)), 6) as r from games" for c in _NUM) + ") x where abs(r) >= 0.01"))
def a13(spark, sf_dir):
    from tipoff.ml.screen import label_correlations

    rows = fx.games(spark, sf_dir).select("is_home_win", *_NUM)
    return rounded(label_correlations(rows, "is_home_win")).where("abs(r) >= 0.01")


@query("a14_class_counts", with_sql("games", "select season_id, is_home_win, cast(count(*) as bigint) as n from games group by 1, 2"))
def a14(spark, sf_dir):
    return fx.games(spark, sf_dir).groupBy("season_id", "is_home_win").agg(F.count(F.lit(1)).alias("n"))
