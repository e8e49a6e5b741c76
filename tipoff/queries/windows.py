"""Time-ordered features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.functions.scalar import ratio
from tipoff.operators import form, lineup, ratings, records, schedule, views
from tipoff.operators.ordered import TEAM_SEASON
from tipoff.queries.base import query, rounded, sql_round
from tipoff.session import written

TEAM_BASE = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pts",
             "tov_pct", "off_rtg", "def_rtg"]
ORDER = "partition by season_id, team order by date, game_id"


def played_team_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team box scores of played games with the derived metrics."""
    played = fx.games(spark, sf_dir).where(F.col("pts_home").isNotNull())
    return views.derived_box(views.team_boxscores(played, TEAM_BASE))


def _sql_team_box() -> str:
    def side(s, o, win):
        own = ", ".join(f"{c}_{s} as {c}" for c in TEAM_BASE)
        opp = ", ".join(f"{c}_{o} as {c}_opponent" for c in views.OPPONENT_STATS)
        return (f"select game_id, date, season_id, {s}_team as team, {o}_team as opponent, '{s}' as side, "
                f"{win} as is_win, {own}, {opp} from games where pts_home is not null")

    return f"{side('home', 'guest', 'is_home_win')} union all {side('guest', 'home', 'not is_home_win')}"


DERIVED = {
    "pace": "0.5e0*(fga + 0.44e0*fta - orb + tov)",
    "net_rtg": "off_rtg - def_rtg",
    "net_rtg_opponent": "off_rtg_opponent - def_rtg_opponent",
    "tov_diff": "tov - tov_opponent",
    "poss_diff": "(fga + 0.44e0*fta) - (fga_opponent + 0.44e0*fta_opponent)",
}
TB = {
    "tb0": _sql_team_box(),
    "tb": "select *, " + ", ".join(f"{e} as {n}" for n, e in DERIVED.items()) + ", pts - pts_opponent as pts_diff from tb0",
}


def frame(w: int, order: str = ORDER) -> str:
    return f"over ({order} rows between {w} preceding and 1 preceding)"


def earlier(order: str = ORDER) -> str:
    return f"over ({order} rows between unbounded preceding and 1 preceding)"


def sql_mean(c, w, least=1, order=ORDER):
    return f"case when count({c}) {frame(w, order)} >= {least} then avg(cast({c} as double)) {frame(w, order)} end"


def sql_std(c, w, least=1, order=ORDER):
    return f"case when count({c}) {frame(w, order)} >= {least} then stddev_samp(cast({c} as double)) {frame(w, order)} end"


def sql_ewm(c, span, least=1, order=ORDER, i="rn"):
    keep = f"(1 - 2e0/({span} + 1))"
    top = f"sum({c} * pow({keep}, -{i})) {earlier(order)}"
    bottom = f"sum(case when {c} is not null then pow({keep}, -{i}) end) {earlier(order)}"
    return f"case when count({c}) {earlier(order)} >= {least} then {top} / nullif({bottom}, 0) end"


def sql_ratios(w: int) -> dict[str, str]:
    def m(n):
        return f"{n}_{w}"

    def r(top, bottom):
        return f"({top}) / nullif({bottom}, 0)"

    shots, shots_o = f"{m('fga')} + 0.44e0*{m('fta')}", f"{m('fga_opponent')} + 0.44e0*{m('fta_opponent')}"
    return {
        "fg_pct": r(m("fg"), m("fga")), "fg3_pct": r(m("fg3"), m("fg3a")), "ft_pct": r(m("ft"), m("fta")),
        "ast_pct": r(m("ast"), m("fg")), "ast_to_tov": r(m("ast"), m("tov")), "fta_rate": r(m("fta"), m("fga")),
        "fg2a_pct": f"1 - {r(m('fg3a'), m('fga'))}",
        "pts_pct_2": r(f"2*({m('fg')} - {m('fg3')})", m("pts")), "ptc_pct_ft": r(m("ft"), m("pts")),
        "eff_fg_pct": r(f"{m('fg')} + 0.5e0*{m('fg3')}", m("fga")),
        "ts_pct": r(m("pts"), f"2*({shots})"),
        "ast_rat": r(f"100*{m('ast')}", f"{shots} + {m('tov')} + {m('ast')}"),
        "trb_pct": r(m("trb"), f"{m('trb')} + {m('trb_opponent')}"),
        "drb_pct": r(m("drb"), f"{m('drb')} + {m('orb_opponent')}"),
        "orb_pct": r(m("orb"), f"{m('orb')} + {m('drb_opponent')}"),
        "fta_rate_opponent": r(m("fta_opponent"), m("fga_opponent")),
        "eff_fg_pct_opponent": r(f"{m('fg_opponent')} + 0.5e0*{m('fg3_opponent')}", m("fga_opponent")),
        "ts_pct_opponent": r(m("pts_opponent"), f"2*({shots_o})"),
    }


STREAK_CTES = {
    "sk0": f"select *, lag(is_win) over ({ORDER}) as prev, row_number() over ({ORDER}) as rn from tb",
    "sk1": f"select *, case when rn = 1 or prev is distinct from lag(prev) over ({ORDER}) then 1 else 0 end as flip from sk0",
    "sk2": f"select *, sum(flip) over ({ORDER} rows unbounded preceding) as streak from sk1",
    "sk3": """select *, count(prev) over (partition by season_id, team, streak order by date, game_id
        rows unbounded preceding) as len from sk2""",
    "tbs": """select *, prev as has_won_last_game,
        cast(case when prev then len else 0 end as bigint) as current_winning_streak,
        cast(case when not prev then len else 0 end as bigint) as current_losing_streak from sk3""",
}


def sql_team_form(windows=(7, 109), least=lambda w: 1) -> dict[str, str]:
    """CTEs up to ``tf``: every column of the team block, unrounded."""
    stats = form.TEAM_STATS
    base = ["game_id", "date", "season_id", "team", "is_win", "has_won_last_game",
            "current_winning_streak", "current_losing_streak", "rn"]
    cols = [f"lag(cast({c} as double)) over ({ORDER}) as {c}_previous_game" for c in stats + ["pts_diff"]]
    for w in windows:
        k = least(w)
        cols += [f"{sql_mean(c, w, k)} as {c}_{w}" for c in stats]
        cols += [f"{sql_ewm(c, w, k)} as {c}_ewm_{w}" for c in stats]
        cols += [f"{sql_std(c, w, k)} as {c}_{w}_std" for c in stats]
        for n, t in (("blowout_wins", "pts_diff >= 15"), ("blowout_losses", "pts_diff <= -15")):
            cols.append(f"cast(case when count(pts_diff) {frame(w)} >= {k} then "
                        f"sum(case when {t} then 1 else 0 end) {frame(w)} end as double) as {n}_{w}")
    ratios = [f"{e} as {n}_{w}" for w in windows for n, e in sql_ratios(w).items()]
    diffs = [f"ts_pct_{w} - ts_pct_opponent_{w} as ts_diff_{w}" for w in windows]
    spreads = []
    for w in windows:
        for c in form.RATIO_STD:
            here = f"over ({ORDER} rows between {w - 1} preceding and current row)"
            spreads.append(f"case when count({c}_{w}) {here} >= {least(w)} then stddev_samp({c}_{w}) {here} end as {c}_{w}_std")
    short, long = windows
    names = [f"{c}_{short}" for c in stats] + [f"{c}_ewm_{short}" for c in stats]
    names += [f"blowout_wins_{short}", f"blowout_losses_{short}"]
    names += [f"{n}_{short}" for n in sql_ratios(short)] + [f"ts_diff_{short}"]
    versus = [f"case when abs({n.replace(f'_{short}', f'_{long}')}) > 1e-9 then {n} / {n.replace(f'_{short}', f'_{long}')} end as {n.replace(f'_{short}', '_vs_avg')}" for n in names]
    return {
        **TB, **STREAK_CTES,
        "f1": f"select {', '.join(base)}, {', '.join(cols)} from tbs",
        "f2": f"select *, {', '.join(ratios)} from f1",
        "f3": f"select *, {', '.join(diffs)} from f2",
        "tf": f"select *, {', '.join(spreads)}, {', '.join(versus)} from f3",
    }


KEYS = "game_id, date, season_id, team"


# --- records ----------------------------------------------------------------

_G = "game_id, date, season_id, home_team, guest_team, is_home_win"
_REC = {
    "r": f"""select *, coalesce(sum(case when win then 1 else 0 end) {earlier()}, 0) as wins,
        row_number() over ({ORDER}) - 1 as played from team_games""",
}


def _fold(columns: list[str], source: str = "r", base: str = "games") -> str:
    return (f"select {', '.join('g.' + c.strip() for c in _G.split(','))}, {', '.join(columns)} from {base} g "
            f"join {source} h on h.game_id = g.game_id and h.side = 'home' "
            f"join {source} a on a.game_id = g.game_id and a.side = 'guest'")


@query("w01_overall_win_pct", with_sql("team_games", _fold([
    "cast(h.played as bigint) as games_this_year_home_team", "cast(a.played as bigint) as games_this_year_guest_team",
    "cast(h.wins as bigint) as wins_this_year_home_team", "cast(a.wins as bigint) as wins_this_year_guest_team",
    "round(h.wins / nullif(h.played, 0), 6) as win_pct_home", "round(a.wins / nullif(a.played, 0), 6) as win_pct_guest",
]), _REC))
def w01(spark, sf_dir):
    return rounded(records.overall_record(fx.games(spark, sf_dir)))


_LOC = {"r": _REC["r"].replace(ORDER, ORDER.replace("team order", "team, side order"))}


@query("w02_location_win_pct", with_sql("team_games", _fold([
    "cast(h.played as bigint) as home_games_this_year_home_team",
    "cast(a.played as bigint) as away_games_this_year_guest_team",
    "cast(h.wins as bigint) as home_wins_this_year_home_team",
    "cast(a.wins as bigint) as away_wins_this_year_guest_team",
    "round(h.wins / nullif(h.played, 0), 6) as home_win_pct_home",
    "round(a.wins / nullif(a.played, 0), 6) as away_win_pct_guest",
]), _LOC))
def w02(spark, sf_dir):
    return rounded(records.location_record(fx.games(spark, sf_dir)))


_PAIR = "partition by season_id, team, opponent order by date, game_id"


@query("w03_head_to_head", with_sql("team_games", f"""
    select g.game_id, g.date, g.season_id, g.home_team, g.guest_team, g.is_home_win,
        cast(r.w as bigint) as h2h_wins_home, cast(r.l as bigint) as h2h_wins_guest, cast(r.n as bigint) as h2h_games,
        round(r.w / nullif(r.n, 0), 6) as h2h_win_pct
    from games g join r on r.game_id = g.game_id and r.side = 'home'""", {
    "r": f"""select game_id, side, coalesce(sum(case when win then 1 else 0 end) {earlier(_PAIR)}, 0) as w,
        coalesce(sum(case when not win then 1 else 0 end) {earlier(_PAIR)}, 0) as l,
        row_number() over ({_PAIR}) - 1 as n from team_games"""}))
def w03(spark, sf_dir):
    return rounded(records.head_to_head(fx.games(spark, sf_dir)))


# --- form, one operator at a time (JVM windows) -------------------------------

@query("w04_previous_game", with_sql("games", f"""select {KEYS},
    {', '.join(f'round(lag(cast({c} as double)) over ({ORDER}), 6) as {c}_previous_game' for c in form.TEAM_STATS + ['pts_diff'])}
    from tb""", TB))
def w04(spark, sf_dir):
    stats = form.TEAM_STATS + ["pts_diff"]
    box = played_team_box(spark, sf_dir).select(
        "*", (F.col("pts") - F.col("pts_opponent")).alias("pts_diff")).select(
        "game_id", "date", "season_id", "team", *[F.col(c).cast("double").alias(c) for c in stats])
    f = form.Form(form.placed(box, TEAM_SEASON, [1]), TEAM_SEASON).lagged(stats)
    return rounded(f.done(["game_id", "date", "season_id", "team", *[f"{c}_previous_game" for c in stats]]))


FEW = ["pts", "ast", "tov", "off_rtg", "pts_opponent"]


def _few(spark, sf_dir, spans=()):
    box = played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *FEW)
    return form.Form(form.placed(box, TEAM_SEASON, form.WINDOWS, spans=spans), TEAM_SEASON)


def _strict(_, w):
    """Without imputation the short window must be full."""
    return form.min_games(w, impute=False)


_LEAST = {7: 7, 109: 1}


@query("w05_rolling_mean", with_sql("games", f"""select {KEYS},
    {', '.join(sql_round(sql_mean(c, w, _LEAST[w]), f'{c}_{w}') for c in FEW for w in (7, 109))} from tb""", TB))
def w05(spark, sf_dir):
    f = _few(spark, sf_dir).rolling(FEW, form.WINDOWS, _strict, std=None)
    return rounded(f.done(["game_id", "date", "season_id", "team", *[f"{c}_{w}" for c in FEW for w in form.WINDOWS]]))


@query("w06_weighted_mean", with_sql("games", f"""select {KEYS},
    {', '.join(sql_round(sql_ewm(c, w, _LEAST[w]), f'{c}_ewm_{w}') for c in FEW for w in (7, 109))}
    from (select *, row_number() over ({ORDER}) as rn from tb) t""", TB))
def w06(spark, sf_dir):
    f = _few(spark, sf_dir, form.WINDOWS).weighted(FEW, form.WINDOWS, _strict)
    return rounded(f.done(["game_id", "date", "season_id", "team", *[f"{c}_ewm_{w}" for c in FEW for w in form.WINDOWS]]))


@query("w07_rolling_std", with_sql("games", f"""select {KEYS},
    {', '.join(sql_round(sql_std(c, w, _LEAST[w]), f'{c}_{w}_std') for c in FEW for w in (7, 109))} from tb""", TB))
def w07(spark, sf_dir):
    f = _few(spark, sf_dir).rolling(FEW, form.WINDOWS, _strict, mean=None)
    return rounded(f.done(["game_id", "date", "season_id", "team", *[f"{c}_{w}_std" for c in FEW for w in form.WINDOWS]]))


@query("w08_blowouts", with_sql("games", f"""select {KEYS}, {', '.join(
    f"cast(case when count(*) {frame(w)} >= {_LEAST[w]} then sum(case when {t} then 1 else 0 end) {frame(w)} end as bigint) as {n}_{w}"
    for n, t in (('blowout_wins', 'pts_diff >= 15'), ('blowout_losses', 'pts_diff <= -15')) for w in (7, 109))} from tb""", TB))
def w08(spark, sf_dir):
    diff = F.col("pts") - F.col("pts_opponent")
    names = ["blowout_wins", "blowout_losses"]
    box = played_team_box(spark, sf_dir).select(
        "game_id", "date", "season_id", "team", (diff >= form.BLOWOUT_MARGIN).cast("bigint").alias(names[0]),
        (diff <= -form.BLOWOUT_MARGIN).cast("bigint").alias(names[1]))
    f = form.Form(form.placed(box, TEAM_SEASON, form.WINDOWS), TEAM_SEASON)
    f.rolling(names, form.WINDOWS, _strict, mean=None, std=None, total="{c}_{w}")
    return f.done(["game_id", "date", "season_id", "team", *[f"{n}_{w}" for n in names for w in form.WINDOWS]])


@query("w09_streaks", with_sql("games", f"""select {KEYS}, has_won_last_game, current_winning_streak,
    current_losing_streak from tbs""", {**TB, **STREAK_CTES}))
def w09(spark, sf_dir):
    return form.streaks(played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", "is_win")).select(
        "game_id", "date", "season_id", "team", "has_won_last_game", "current_winning_streak", "current_losing_streak")


_LAGGED = {"l": f"""select {KEYS}, {', '.join(f'avg(cast({c} as double)) {frame(w)} as {c}_{w}'
    for c in ('fg', 'fga', 'pts', 'fta') for w in (7, 109))} from tb""",
    "s": f"""select {KEYS}, {', '.join(
        f'fg_{w} / nullif(fga_{w}, 0) as fg_pct_{w}, pts_{w} / nullif(2*(fga_{w} + 0.44e0*fta_{w}), 0) as ts_pct_{w}'
        for w in (7, 109))} from l"""}


@query("w10_ratio_std", with_sql("games", f"""select {KEYS}, {', '.join(
    sql_round(f'stddev_samp({c}_{w}) over ({ORDER} rows between {w - 1} preceding and current row)', f'{c}_{w}_std')
    for c in ('fg_pct', 'ts_pct') for w in (7, 109))} from s""", {**TB, **_LAGGED}))
def w10(spark, sf_dir):
    need = ["fg", "fga", "pts", "fta"]
    box = played_team_box(spark, sf_dir).select("game_id", "date", "season_id", "team", *need)
    f = form.Form(form.placed(box, TEAM_SEASON, form.WINDOWS, reach=2), TEAM_SEASON)
    f.rolling(need, form.WINDOWS, lambda c, w: 1, std=None)
    for w in form.WINDOWS:
        shots = 2 * (F.col(f"fga_{w}") + 0.44 * F.col(f"fta_{w}"))
        f._add({f"fg_pct_{w}": ratio(f"fg_{w}", f"fga_{w}"), f"ts_pct_{w}": ratio(f"pts_{w}", shots)})
    for w in form.WINDOWS:
        f.rolling([f"fg_pct_{w}", f"ts_pct_{w}"], [w], lambda c, w: 1, mean=None, std="{c}_std", include_current=True)
    return rounded(f.done(["game_id", "date", "season_id", "team",
                           *[f"{c}_{w}_std" for c in ("fg_pct", "ts_pct") for w in form.WINDOWS]]))


# --- the full blocks (Arrow batches) ------------------------------------------

def team_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.team_form(written(played_team_box(spark, sf_dir), "team-box"))


_TF = [c for c in form.team_columns()]


@query("w11_team_form", with_sql("games", f"""select {KEYS}, is_win, has_won_last_game, current_winning_streak,
    current_losing_streak, {', '.join(sql_round(c, c, nudge=True) for c in _TF)} from tf""", sql_team_form()))
def w11(spark, sf_dir):
    return rounded(team_features(spark, sf_dir), nudge=True)


PORDER = "partition by season_id, player_id order by date, game_id"


def sql_player_form(windows=(7, 109)) -> dict[str, str]:
    cols = [f"lag({c}) over ({PORDER}) as {c}_previous_game" for c in form.PLAYER_STATS]
    for w in windows:
        for c in form.PLAYER_STATS:
            cols += [f"{sql_mean(c, w, 1, PORDER)} as {c}_{w}", f"{sql_ewm(c, w, 1, PORDER)} as {c}_ewm_{w}",
                     f"{sql_std(c, w, 1, PORDER)} as {c}_{w}_std"]
    return {
        "pr": f"select *, row_number() over ({PORDER}) as rn from player_box",
        "pf": f"select game_id, date, season_id, player_id, team_id, {', '.join(cols)} from pr",
    }


PF = [f"{c}_previous_game" for c in form.PLAYER_STATS] + [
    f"{c}_{k}" for c in form.PLAYER_STATS for w in form.WINDOWS for k in (f"{w}", f"ewm_{w}", f"{w}_std")]


@query("w12_player_form", with_sql("player_box", f"""select game_id, date, season_id, player_id, team_id,
    {', '.join(sql_round(c, c) for c in PF)} from pf""", sql_player_form()))
def w12(spark, sf_dir):
    return rounded(form.player_form(written(fx.player_box(spark, sf_dir), "player-box")))


# --- schedule ------------------------------------------------------------------

_TGV = {
    "tgv": """select game_id, date, season_id, home_team as team, 'home' as side, latitude, longitude from season_games
        union all select game_id, date, season_id, guest_team, 'guest', latitude, longitude from season_games""",
    "lg0": f"select *, lag(latitude) over ({ORDER}) as plat, lag(longitude) over ({ORDER}) as plon from tgv",
    "lg": """select *, coalesce(2*6371.0e0*asin(sqrt(pow(sin(radians(latitude - plat)/2), 2)
        + cos(radians(plat))*cos(radians(latitude))*pow(sin(radians(longitude - plon)/2), 2))), 0) as leg from lg0""",
    "r": f"""select game_id, side, round(leg, 2) as d1,
        round(sum(leg) over (partition by season_id, team order by date range between interval 7 days preceding and current row)
          - coalesce(sum(leg) over (partition by season_id, team, date order by game_id
                rows between 1 following and unbounded following), 0), 2) as d7,
        round(sum(leg) over ({ORDER} rows unbounded preceding), 2) as dt from lg""",
}
_TRAVEL = ["km_since_last_game", "km_last_7_days", "km_season_total"]


@query("w13_travel", with_sql("season_games", f"""select g.game_id, g.date, g.season_id, g.home_team, g.guest_team,
    {', '.join(f'{a}.{s} as {p}_{n}' for p, a in (('home', 'h'), ('guest', 'a')) for s, n in zip(('d1', 'd7', 'dt'), _TRAVEL))}
    from season_games g join r h on h.game_id = g.game_id and h.side = 'home'
    join r a on a.game_id = g.game_id and a.side = 'guest'""", _TGV))
def w13(spark, sf_dir):
    return schedule.travel(fx.season_games(spark, sf_dir))


_DATES = {
    "d": "select distinct season_id, team, date from team_games",
    "dd": """select *, cast(date - lag(date) over (partition by season_id, team order by date) as bigint) as days_rest,
        cast(count(*) over (partition by season_id, team order by date
            range between interval 3 days preceding and interval 1 day preceding) as bigint) as games_last_3_density,
        cast(count(*) over (partition by season_id, team order by date
            range between interval 5 days preceding and interval 1 day preceding) as bigint) as games_last_5_density from d""",
}
_REST = ["days_rest", "games_last_3_density", "games_last_5_density"]


@query("w14_rest_days", with_sql("team_games", f"""select g.game_id, g.date, g.season_id, g.home_team, g.guest_team,
    {', '.join(f'{a}.{n} as {p}_{n}' for p, a in (('home', 'h'), ('guest', 'a')) for n in _REST)},
    h.days_rest = 1 as is_b2b_home, a.days_rest = 1 as is_b2b_guest
    from games g join dd h on h.season_id = g.season_id and h.team = g.home_team and h.date = g.date
    join dd a on a.season_id = g.season_id and a.team = g.guest_team and a.date = g.date""", _DATES))
def w14(spark, sf_dir):
    return schedule.rest(fx.games(spark, sf_dir))


@query("w15_game_density", with_sql("team_games",
       "select season_id, team, date, days_rest, games_last_3_density, games_last_5_density from dd", _DATES))
def w15(spark, sf_dir):
    return schedule.rest_by_date(fx.games(spark, sf_dir))


_CLUTCH = {
    "c0": """select game_id, date, season_id, team, side, win, pts_home, pts_guest,
        abs(pts_home - pts_guest) <= 5 and abs(pts_home - pts_guest) > 0 as is_clutch_game
        from team_games join (select game_id as gid, pts_home, pts_guest from games) p on gid = game_id""",
    "c1": f"""select game_id, team, avg(case when win then 1.0e0 else 0 end)
        over ({ORDER} rows between 108 preceding and current row) as share from c0 where is_clutch_game""",
    "c2": "select c0.*, share from c0 left join c1 on c0.game_id = c1.game_id and c0.team = c1.team",
    "r": f"select *, last_value(share ignore nulls) {earlier()} as pct from c2",
}


@query("w16_clutch", with_sql("team_games", """select g.game_id, g.date, g.season_id, g.home_team, g.guest_team,
    h.is_clutch_game, round(h.pct, 6) as clutch_win_pct_home, round(a.pct, 6) as clutch_win_pct_guest
    from games g join r h on h.game_id = g.game_id and h.side = 'home'
    join r a on a.game_id = g.game_id and a.side = 'guest'""", _CLUTCH))
def w16(spark, sf_dir):
    return rounded(schedule.clutch(fx.games(spark, sf_dir)))


@query("w17_forward_fill", with_sql("team_games", f"""select game_id, team, last_value(margin ignore nulls)
    over ({ORDER} rows between unbounded preceding and current row) as margin from
    (select t.*, case when abs(pts_home - pts_guest) <= 5 then pts_home - pts_guest end as margin
     from team_games t join (select game_id as gid, pts_home, pts_guest from games) g on gid = game_id) x"""))
def w17(spark, sf_dir):
    games = fx.games(spark, sf_dir)
    margin = F.col("pts_home") - F.col("pts_guest")
    flagged = games.select("*", F.when(F.abs(margin) <= 5, margin).alias("margin"))
    rows = views.team_rows(flagged, ["game_id", "date", "season_id", "margin"])
    return schedule.forward_filled(rows, TEAM_SEASON, "margin").select("game_id", "team", "margin")


_ELO_ORDER = "partition by team order by date, game_id"


@query("w18_elo_change", with_sql("team_games", f"""select game_id, date, team as team_id,
    round(x - lag(x, 7) over ({_ELO_ORDER}), 6) as elo_change_7_absolute,
    round(x / nullif(lag(x, 7) over ({_ELO_ORDER}), 0) - 1, 6) as elo_change_7_relative
    from (select t.*, 1500e0 + pts_home - 0.5e0*pts_guest as x from team_games t
          join (select game_id as gid, pts_home, pts_guest from games) g on gid = game_id where pts_home is not null) y"""))
def w18(spark, sf_dir):
    """The change operator on a rating-like series that SQL can rebuild; real ratings are E01-E03."""
    games = fx.games(spark, sf_dir).where(F.col("pts_home").isNotNull())
    series = (1500.0 + F.col("pts_home") - 0.5 * F.col("pts_guest")).alias("elo_before")
    rows = views.team_rows(games.select("*", series), ["game_id", "date", "elo_before"]).select(
        "game_id", "date", F.col("team").alias("team_id"), "elo_before")
    return rounded(ratings.elo_change(rows).drop("elo_before"))


_HIST = {"h": """select *, coalesce(mp_7, mp_109) as historical_minutes from pf
    where coalesce(mp_7, mp_109) is not null""",
    "t": """select * from (select *, row_number() over (partition by game_id, team_id
        order by historical_minutes desc, player_id) as place from h) x where place <= 2"""}


def player_features(spark: SparkSession, sf_dir: str, columns: list[str], latest: bool = False,
                    keep: tuple[str, ...] = tuple(form.PLAYER_KEYS)) -> DataFrame:
    """Those features of every player game that a query reads (with ``latest``: of every player's last games); each query reads them once, so
    they are not written. Of the box scores, only the stats behind them are summed and written."""
    return form.player_form(player_box_of(spark, sf_dir, columns), columns=columns, latest=latest, keep=keep)


def player_box_of(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return written(fx.player_box(spark, sf_dir).select(*form.PLAYER_KEYS, *form.stats_of(columns)), "player-box")


MINUTES = ["mp_7", "mp_109"]


@query("w19_top_players", with_sql("player_box", """select game_id, team_id, player_id, cast(place as bigint) as place,
    round(historical_minutes, 6) as historical_minutes from t""", {**sql_player_form(), **_HIST}))
def w19(spark, sf_dir):
    top = lineup.top_players(lineup.with_history(player_features(spark, sf_dir, MINUTES, keep=lineup.LINE_UP_KEYS)), 2)
    return rounded(top.select("game_id", "team_id", "player_id", F.col("place").cast("bigint").alias("place"),
                              "historical_minutes"))


_MIN = {
    "u": "select *, historical_minutes / nullif(sum(historical_minutes) over (partition by game_id, team_id), 0) as usage_rate from t",
    "v": "select *, least(usage_rate*240, 48) as capped from u",
    "m": "select *, capped * (240 / nullif(sum(capped) over (partition by game_id, team_id), 0)) as expected_minutes from v",
}


@query("w20_expected_minutes", with_sql("player_box", """select game_id, team_id, player_id,
    round(usage_rate, 6) as usage_rate, round(expected_minutes, 6) as expected_minutes from m""",
    {**sql_player_form(), **_HIST, **_MIN}))
def w20(spark, sf_dir):
    top = lineup.top_players(lineup.with_history(player_features(spark, sf_dir, MINUTES, keep=lineup.LINE_UP_KEYS)), 2)
    return rounded(lineup.expected_minutes(top).select(
        "game_id", "team_id", "player_id", "usage_rate", "expected_minutes"))


@query("w21_team_records", with_sql("team_games", f"""select concat(game_id, '_', team) as id, game_id, season_id, team,
    cast(w as bigint) as wins_before, cast(l as bigint) as losses_before from r
    where not (win is null and w = 0 and l = 0)""", {
    "r": f"""select *, coalesce(sum(case when win then 1 else 0 end) {earlier()}, 0) as w,
        coalesce(sum(case when not win then 1 else 0 end) {earlier()}, 0) as l from team_games"""}))
def w21(spark, sf_dir):
    return records.team_records(fx.games(spark, sf_dir))
