"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.functions import scalar as S
from tipoff.functions import select as pick
from tipoff.operators import form, lineup, views
from tipoff.operators.ordered import TEAM_SEASON
from tipoff.operators.relational import with_venue_and_phase
from tipoff.queries.base import query, rounded, sql_round
from tipoff.queries.windows import (
    FEW, KEYS, ORDER, TB, TEAM_BASE, frame, played_team_box, sql_ewm, sql_mean, sql_player_form, sql_ratios, sql_std,
    team_features, sql_team_form,
)


@query("p01_team_rows", with_sql("team_games", "select game_id, date, season_id, team, opponent, side, win from team_games"))
def p01(spark, sf_dir):
    return views.team_rows(fx.games(spark, sf_dir), ["game_id", "date", "season_id"])


_OWN_OPP = TEAM_BASE + [f"{c}_opponent" for c in views.OPPONENT_STATS]


@query("p02_team_boxscores", with_sql("games", f"""select game_id, date, season_id, team, opponent, side, is_win,
    is_win as is_win_opponent, {', '.join(sql_round(c, c) if 'rtg' in c or 'pct' in c else c for c in _OWN_OPP)} from tb0""", TB))
def p02(spark, sf_dir):
    played = fx.games(spark, sf_dir).where(F.col("pts_home").isNotNull())
    return rounded(views.team_boxscores(played, TEAM_BASE))


_DERIVED = ["pace", "net_rtg", "net_rtg_opponent", "tov_diff", "poss_diff"]


@query("p03_derived_box", with_sql("games", f"""select {KEYS},
    {', '.join(c if c == 'tov_diff' else sql_round(c, c) for c in _DERIVED)} from tb""", TB))
def p03(spark, sf_dir):
    return rounded(played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *_DERIVED))


_RATIO_NEEDS = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "ast", "tov", "pts", "trb", "drb", "orb", "trb_opponent",
                "drb_opponent", "orb_opponent", "fg_opponent", "fga_opponent", "fta_opponent", "fg3_opponent", "pts_opponent"]


@query("p04_window_ratios", with_sql("games", f"""select {KEYS},
    {', '.join(sql_round(e, f'{n}_7', nudge=True) for n, e in sql_ratios(7).items())} from m""",
    {**TB, "m": f"select {KEYS}, {', '.join(f'{sql_mean(c, 7)} as {c}_7' for c in _RATIO_NEEDS)} from tb"}))
def p04(spark, sf_dir):
    box = played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *_RATIO_NEEDS)
    f = form.Form(form.placed(box, TEAM_SEASON, [7]), TEAM_SEASON)
    f.rolling(_RATIO_NEEDS, [7], lambda c, w: 1, std=None)
    ratios = form.window_ratios(lambda n: F.col(f"{n}_7"))
    f._add({f"{n}_7": e for n, e in ratios.items()})
    return rounded(f.done(["game_id", "date", "season_id", "team", *[f"{n}_7" for n in ratios]]), nudge=True)


@query("p05_shooting_gap", with_sql("games", f"""select {KEYS},
    {', '.join(sql_round(f'ts_diff_{w}', f'ts_diff_{w}') for w in (7, 109))} from tf""", sql_team_form()))
def p05(spark, sf_dir):
    return rounded(team_features(spark, sf_dir).select("game_id", "date", "season_id", "team", "ts_diff_7", "ts_diff_109"))


_POS = ["pts", "ast", "tov", "pts_opponent"]


@query("p06_recent_vs_season", with_sql("games", f"""select {KEYS}, {', '.join(
    sql_round(f'{c}{k}_7 / nullif({c}{k}_109, 0)', f'{c}{k}_vs_avg', nudge=True) for c in _POS for k in ('', '_ewm'))} from m""",
    {**TB, "m": f"select {KEYS}, " + ", ".join(
        f"{sql_mean(c, w)} as {c}_{w}, {sql_ewm(c, w)} as {c}_ewm_{w}, {sql_std(c, w)} as {c}_{w}_std"
        for c in _POS for w in (7, 109)) + f" from (select *, row_number() over ({ORDER}) as rn from tb) t"}))
def p06(spark, sf_dir):
    box = played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *_POS)
    f = form.Form(form.placed(box, TEAM_SEASON, form.WINDOWS, spans=form.WINDOWS), TEAM_SEASON)
    f.rolling(_POS, form.WINDOWS, lambda c, w: 1).weighted(_POS, form.WINDOWS, lambda c, w: 1)
    shown = [c for c in f.df.columns if not c.startswith("__")]
    f.df = f.df.select(*shown, "__block", "__home")
    versus = form.vs_average(f.df.select(*shown), *form.WINDOWS)
    f._add(versus)
    return rounded(f.done(["game_id", "date", "season_id", "team", *versus]), nudge=True)


@query("p07_role_rename", with_sql("season_games", """select game_id as game_id_home, team as team_home, pts as pts_home,
    ast as ast_home, tov as tov_home from tb""", TB))
def p07(spark, sf_dir):
    box = played_team_box(spark, sf_dir).select("game_id", "team", "pts", "ast", "tov")
    return pick.suffixed(box, "_home")


_BOX_INT = [f"{c}_{s}" for s in ("home", "guest") for c in fx.BOX_STATS + ["trb", "pts"]]


@query("p08_column_patterns", with_sql("box", f"""select game_id, {', '.join(c for c in _BOX_INT if c.endswith('_home'))},
    round(off_rtg_home, 6) as off_rtg_home, round(def_rtg_home, 6) as def_rtg_home, round(tov_pct_home, 6) as tov_pct_home
    from box"""))
def p08(spark, sf_dir):
    box = fx.box(spark, sf_dir).withColumn("note", F.lit("text column"))
    return rounded(pick.numeric(pick.without(box, r"_guest|is_win")))


@query("p09_history_filter", with_sql("games", f"""select {KEYS} from m where
    ({' and '.join(f'{c}_previous_game is not null' for c in FEW)}) or ({' and '.join(f'{c}_7_std is not null' for c in FEW)})""",
    {**TB, "m": f"select {KEYS}, " + ", ".join(
        f"lag({c}) over ({ORDER}) as {c}_previous_game, stddev_samp({c}) {frame(7)} as {c}_7_std" for c in FEW) + " from tb"}))
def p09(spark, sf_dir):
    box = played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *FEW)
    f = form.Form(form.placed(box, TEAM_SEASON, [7]), TEAM_SEASON)
    f.lagged(FEW).rolling(FEW, [7], lambda c, w: 1, mean=None)
    rows = f.done(["game_id", "date", "season_id", "team",
                   *[f"{c}_previous_game" for c in FEW], *[f"{c}_7_std" for c in FEW]])
    return pick.with_history(rows).select("game_id", "date", "season_id", "team")


@query("p10_finite", with_sql("box", """select game_id, round(pts_home / nullif(fga_guest, 0), 6) as x,
    round(pts_guest / nullif(fga_home, 0), 6) as y from box"""))
def p10(spark, sf_dir):
    def raw(top, bottom):  # the unguarded quotient, as it would arrive from outside
        return F.when(F.col(bottom) == 0, F.lit(float("inf"))).otherwise(S.ratio(top, bottom))

    rows = fx.box(spark, sf_dir).select("game_id", raw("pts_home", "fga_guest").alias("x"), raw("pts_guest", "fga_home").alias("y"))
    return rounded(pick.all_finite(rows))


@query("p11_numeric_text", """select l_orderkey, l_linenumber, case when l_linenumber = 4 then null else l_quantity end as value
    from lineitem""")
def p11(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 4, F.lit("Did Not Play")).otherwise(F.col("l_quantity").cast("string"))
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.number(text).alias("value"))


@query("p12_minutes_text", """select l_orderkey, l_linenumber, case when l_linenumber = 4 then null
    else round(l_partkey % 48 + (l_suppkey % 60) / 60.0e0, 6) end as mp from lineitem""")
def p12(spark, sf_dir):
    clock = F.concat_ws(":", (F.col("l_partkey") % 48).cast("string"),
                        F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"))
    text = F.when(F.col("l_linenumber") == 4, F.lit("Did Not Play")).otherwise(clock)
    return rounded(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.minutes(text).alias("mp")))


@query("p13_date_text", """select o_orderkey, case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end as date,
    cast(o_orderdate as date) as iso from orders""")
def p13(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("postponed")).otherwise(F.date_format(day, "EEE, MMM d, yyyy"))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", S.long_date(text).alias("date"), F.to_date(day.cast("string")).alias("iso"))


@query("p14_keys", with_sql("sched", """select game_id, strftime(date, '%Y%m%d') || upper(substr(n_name, 1, 3)) as game_key,
    concat(game_id, '_', upper(substr(n_name, 1, 3))) as record_key from sched join nation on n_nationkey = home_team"""))
def p14(spark, sf_dir):
    nation = fx.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("home_team"), F.upper(F.substring("n_name", 1, 3)).alias("abbrev"))
    return fx.sched(spark, sf_dir).join(nation, "home_team").select(
        "game_id", S.game_key("date", "abbrev").alias("game_key"), S.composite_key("game_id", "abbrev").alias("record_key"))


@query("p15_playoff_flag", with_sql("sched playoffs", """select game_id, date, s.season_id,
    date >= playoff_start as is_playoff_game from sched s join playoffs p on s.season_id = p.season_id"""))
def p15(spark, sf_dir):
    rows = with_venue_and_phase(fx.sched(spark, sf_dir), fx.location(spark, sf_dir), fx.playoffs(spark, sf_dir))
    return rows.select("game_id", "date", "season_id", "is_playoff_game")


@query("p16_date_ranges", with_sql("sched", """select game_id, date, date < date '1997-03-01' as before from sched
    where date between date '1997-01-01' and date '1997-03-31'"""))
def p16(spark, sf_dir):
    rows = fx.sched(spark, sf_dir).where(pick.between_days("date", "1997-01-01", "1997-03-31"))
    return rows.select("game_id", "date", (F.col("date") < F.lit("1997-03-01").cast("date")).alias("before"))


def _two_stats(spark, sf_dir):
    return form.player_form(fx.player_box(spark, sf_dir), stats=["mp", "pts"], impute=False)


_PF_STRICT = {"pf": f"""select game_id, player_id, lag(pts) over (partition by season_id, player_id order by date, game_id) as pts_previous_game,
    {', '.join(f"{sql_mean(c, w, 7 if w == 7 and c != 'mp' else 1, 'partition by season_id, player_id order by date, game_id')} as {c}_{w}"
               for c in ('pts', 'mp') for w in (7, 109))} from player_box"""}


@query("p17_fallback", with_sql("player_box", """select game_id, player_id,
    round(coalesce(pts_previous_game, pts_109, 0), 6) as last, round(coalesce(pts_7, pts_109, 0), 6) as recent from pf""", _PF_STRICT))
def p17(spark, sf_dir):
    return rounded(_two_stats(spark, sf_dir).select(
        "game_id", "player_id", S.fallback("pts_previous_game", "pts_109").alias("last"),
        S.fallback("pts_7", "pts_109").alias("recent")))


@query("p18_blend", with_sql("player_box", "select game_id, player_id, {blended} as pts_weighted from pf".format(
    blended=sql_round("0.15e0*coalesce(pts_previous_game, pts_109, 0) + 0.35e0*coalesce(pts_7, pts_109, 0)"
                      " + 0.5e0*coalesce(pts_109, 0)", "x", nudge=True).removesuffix(" as x")), _PF_STRICT))
def p18(spark, sf_dir):
    return rounded(_two_stats(spark, sf_dir).select(
        "game_id", "player_id", S.blend("pts_previous_game", "pts_7", "pts_109").alias("pts_weighted")),
        nudge=True)


@query("p19_cap", with_sql("player_box", "select game_id, player_id, least(mp, 48) as mp from player_box"))
def p19(spark, sf_dir):
    return fx.player_box(spark, sf_dir).select("game_id", "player_id", S.cap("mp", 48.0).alias("mp"))


@query("p20_great_circle", with_sql("sched location", """select game_id, round(2*6371.0e0*asin(sqrt(
    pow(sin(radians(g.latitude - h.latitude)/2), 2) + cos(radians(h.latitude))*cos(radians(g.latitude))
    *pow(sin(radians(g.longitude - h.longitude)/2), 2))), 4) as km
    from sched join location h on h.arena = home_team join location g on g.arena = guest_team"""))
def p20(spark, sf_dir):
    places = fx.location(spark, sf_dir)
    home = places.select(F.col("arena").alias("home_team"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    guest = places.select(F.col("arena").alias("guest_team"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    rows = fx.sched(spark, sf_dir).join(home, "home_team").join(guest, "guest_team")
    return rows.select("game_id", F.round(S.haversine_km("lat1", "lon1", "lat2", "lon2"), 4).alias("km"))


@query("p21_elo_terms", with_sql("box", """select game_id, round(1/(1 + pow(10, (b - a)/400)), 6) as expected,
    round(pow(abs(pts_home - pts_guest) + 3, 0.8e0)/(7.5e0 + 0.006e0*abs(a - b)), 6) as factor
    from (select *, 1500e0 + fga_home as a, 1500e0 + fga_guest as b from box) x"""))
def p21(spark, sf_dir):
    a, b = 1500.0 + F.col("fga_home"), 1500.0 + F.col("fga_guest")
    margin = F.abs(F.col("pts_home") - F.col("pts_guest"))
    return rounded(fx.box(spark, sf_dir).select(
        "game_id", S.elo_expected(a, b).alias("expected"), S.elo_margin_factor(margin, F.abs(a - b)).alias("factor")))


@query("p22_matrix_types", with_sql("games", """select game_id, cast(is_home_win as int)::double as is_home_win,
    cast(pts_home as double) as pts_home, cast(season_id as double) as season_id from games"""))
def p22(spark, sf_dir):
    rows = fx.games(spark, sf_dir).select("game_id", "is_home_win", "pts_home", "season_id")
    return pick.as_doubles(rows, keep=["game_id"])


@query("p23_label_codes", """with train as (select c_mktsegment as s, count(*) as n from customer where c_custkey % 4 <> 0 group by 1),
    codes as (select s, cast(row_number() over (order by n desc, s) - 1 as double) as code from train)
    select c_custkey, coalesce(code, (select cast(count(*) as double) from codes)) as code
    from customer left join codes on s = c_mktsegment""")
def p23(spark, sf_dir):
    customer = fx.table(spark, sf_dir, "customer")
    train = customer.where(F.col("c_custkey") % 4 != 0)  # codes are learned on the training rows only
    model = StringIndexer(inputCol="c_mktsegment", outputCol="code", handleInvalid="keep").fit(train)
    return model.transform(customer).select("c_custkey", "code")


@query("p24_availability", with_sql("roster", """select player_id, team_id, injury is not null as doubtful from roster
    where injury is null or starts_with(injury, 'Day')"""))
def p24(spark, sf_dir):
    return lineup.available(fx.roster(spark, sf_dir)).select("player_id", "team_id", "doubtful")


@query("p25_threshold", with_sql("pred", "select game_id, proba_a >= 0.5 as is_predicted_home_win_a, proba_b >= 0.62e0 as is_predicted_home_win_b from pred"))
def p25(spark, sf_dir):
    return fx.pred(spark, sf_dir).select(
        "game_id", S.predicted("proba_a").alias("is_predicted_home_win_a"),
        S.predicted("proba_b", 0.62).alias("is_predicted_home_win_b"))


@query("p26_row_keys", with_sql("team_games", "select sha256(concat(game_id, '_', team)) as id, game_id, team from team_games"))
def p26(spark, sf_dir):
    rows = views.team_rows(fx.games(spark, sf_dir), ["game_id"])
    return rows.select(S.row_key("game_id", "team").alias("id"), "game_id", "team")


@query("p27_outcome_label", with_sql("games", "select game_id, pts_home, pts_guest, is_home_win from games"))
def p27(spark, sf_dir):
    return fx.games(spark, sf_dir).select("game_id", "pts_home", "pts_guest", "is_home_win")
