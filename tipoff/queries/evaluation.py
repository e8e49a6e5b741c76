"""Splits, weights and evaluation that SQL can check row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.ml import attribution, combine, metrics, scoring, split
from tipoff.queries.base import query, rounded

_RN = "row_number() over (order by date, game_id) - 1 as rn, count(*) over () as n"


@query("m01_train_test", with_sql("sched", f"""select game_id, date, case when rn < round_even(n * 0.85e0, 0) then 'train' else 'test' end as role
    from (select *, {_RN} from sched where date < date '2000-06-01') x"""))
def m01(spark, sf_dir):
    return split.train_test(fx.sched(spark, sf_dir).select("game_id", "date"), "2000-06-01")


@query("m02_hold_out", with_sql("sched", f"""select game_id, date, case when rn < floor(n * (1 - 0.15e0)) then 'tune' else 'meta' end as role
    from (select *, {_RN} from sched) x"""))
def m02(spark, sf_dir):
    return split.hold_out(fx.sched(spark, sf_dir).select("game_id", "date"), 0.15)


@query("m03_expanding_folds", with_sql("sched", f"""select game_id, date, cast(f as bigint) as fold,
    case when rn < n - (5 - f) * (n // 6) then 'train' else 'test' end as role
    from (select *, {_RN} from sched) x, (select unnest(range(5)) as f) g
    where rn < n - (5 - f) * (n // 6) + n // 6"""))
def m03(spark, sf_dir):
    return split.expanding_folds(fx.sched(spark, sf_dir).select("game_id", "date"))


@query("m04_stratified_folds", with_sql("games", """select game_id, is_home_win, cast((row_number() over (partition by is_home_win
    order by (game_id * 2654435761) % 4294967296, game_id) - 1) % 5 as bigint) as fold from games where is_home_win is not null"""))
def m04(spark, sf_dir):
    rows = fx.games(spark, sf_dir).where("is_home_win is not null").select("game_id", "is_home_win")
    return split.stratified_folds(rows, "is_home_win").withColumn("fold", F.col("fold").cast("bigint"))


@query("m05_recency_weights", with_sql("sched", """select game_id, date, round(w * n / s, 6) as sample_weight,
    round(w2 * n / s2, 6) as row_weight from
    (select *, count(*) over () as n, sum(w) over () as s, sum(w2) over () as s2 from
     (select *, pow(0.99e0, max(date) over () - date) as w,
        pow(0.999e0, count(*) over () - row_number() over (order by date, game_id)) as w2 from sched) x) y"""))
def m05(spark, sf_dir):
    rows = split.recency_weights(fx.sched(spark, sf_dir).select("game_id", "date"))
    plain = fx.sched(spark, sf_dir).select("game_id", "date")
    by_row = split.recency_weights(plain, 0.999, by="row").withColumnRenamed("sample_weight", "row_weight")
    return rounded(rows.join(by_row.drop("date"), "game_id"))


_P = ["proba_a", "proba_b", "proba_c"]


@query("m13_vote_and_average", with_sql("pred", """select game_id, round((proba_a + proba_b + proba_c) / 3, 6) as proba_ensemble,
    (case when proba_a >= 0.5 then 1 else 0 end + case when proba_b >= 0.5 then 1 else 0 end
     + case when proba_c >= 0.5 then 1 else 0 end) >= 2 as is_predicted_home_win from pred"""))
def m13(spark, sf_dir):
    return rounded(fx.pred(spark, sf_dir).select(
        "game_id", combine.average(_P).alias("proba_ensemble"), combine.hard_vote(_P).alias("is_predicted_home_win")))


_TH = {"th": """select k / 100.0e0 as threshold, cast(count(*) filter (proba_a >= k/100.0e0 and is_home_win) as bigint) as tp,
    cast(count(*) filter (proba_a >= k/100.0e0 and not is_home_win) as bigint) as fp,
    cast(count(*) filter (proba_a < k/100.0e0 and is_home_win) as bigint) as fn,
    cast(count(*) filter (proba_a < k/100.0e0 and not is_home_win) as bigint) as tn
    from pred, (select unnest(range(1, 100)) as k) t where is_home_win is not null group by k""",
    "ts": """select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
    coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
    (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as balanced_accuracy,
    tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1 as youden from th""",
    "tf2": "select *, 5 * precision * recall / nullif(4 * precision + recall, 0) as fbeta from ts"}


@query("m18_threshold_scores", with_sql("pred", """select threshold, tp, fp, fn, tn, round(accuracy, 6) as accuracy,
    round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(fbeta, 6) as fbeta,
    round(balanced_accuracy, 6) as balanced_accuracy, round(youden, 6) as youden from tf2""", _TH))
def m18(spark, sf_dir):
    return rounded(metrics.threshold_scores(fx.pred(spark, sf_dir), "is_home_win", "proba_a", beta=2.0))


@query("m18_best_threshold", with_sql("pred", " union all ".join(
    f"select * from (select '{m}' as metric, threshold, round({m}, 6) as score from tf2 where {m} is not null order by {m} desc, threshold limit 1) {m}"
    for m in ("f1", "accuracy", "precision", "recall")), _TH))
def m18_best(spark, sf_dir):
    rows = None
    for m in ("f1", "accuracy", "precision", "recall"):
        one = metrics.best_threshold(fx.pred(spark, sf_dir), "is_home_win", "proba_a", m)
        rows = one if rows is None else rows.unionByName(one)
    return rounded(rows)


def _sql_metrics(p):
    return f"""avg(case when ({p} >= 0.5) = is_home_win then 1e0 else 0 end) as accuracy,
    coalesce(count(*) filter ({p} >= 0.5 and is_home_win) / nullif(count(*) filter ({p} >= 0.5), 0), 0) as precision,
    coalesce(count(*) filter ({p} >= 0.5 and is_home_win) / nullif(count(*) filter (is_home_win), 0), 0) as recall,
    coalesce(2 * count(*) filter ({p} >= 0.5 and is_home_win) / nullif(count(*) filter ({p} >= 0.5) + count(*) filter (is_home_win), 0), 0) as f1,
    avg(-ln(case when is_home_win then greatest({p}, 2.220446049250313e-16) else 1 - least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16) end)) as log_loss"""


@query("m19_binary_metrics", with_sql("pred", f"""select {', '.join(f'round({m}, 6) as {m}' for m in ('accuracy', 'precision', 'recall', 'f1', 'log_loss'))}
    from (select {_sql_metrics('proba_a')} from pred where is_home_win is not null) x"""))
def m19(spark, sf_dir):
    return rounded(metrics.evaluate(fx.pred(spark, sf_dir), "is_home_win", "proba_a", ["accuracy", "precision", "recall", "f1", "log_loss"]))


@query("m19_class_report", with_sql("pred", """select o as outcome, round(tp / nullif(tp + fp, 0), 6) as precision,
    round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, cast(tp + fn as bigint) as support from
    (select o, count(*) filter ((proba_a >= 0.5) = o and is_home_win = o) as tp, count(*) filter ((proba_a >= 0.5) = o and is_home_win <> o) as fp,
     count(*) filter ((proba_a >= 0.5) <> o and is_home_win = o) as fn from pred, (select unnest([true, false]) as o) s group by o) x"""))
def m19_report(spark, sf_dir):
    return rounded(metrics.class_report(fx.pred(spark, sf_dir), "is_home_win", "proba_a"))


_AUC = """(select (sum(case when is_home_win then rk end) - p * (p + 1) / 2e0) / (p * q) as roc_auc from
    (select is_home_win, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as rk,
     count(*) filter (is_home_win) over () as p, count(*) filter (not is_home_win) over () as q from pred where is_home_win is not null) x group by p, q)"""


@query("m20_roc_auc", with_sql("pred", f"select round(roc_auc, 6) as roc_auc from {_AUC.format(c='proba_b')} a"))
def m20(spark, sf_dir):
    return rounded(metrics.roc_auc(fx.pred(spark, sf_dir), "is_home_win", "proba_b"))


@query("m21_compare_models", with_sql("pred", " union all ".join(
    f"""select '{m}' as model, round(roc_auc, 6) as roc_auc, {', '.join(f'round({x}, 6) as {x}' for x in ('accuracy', 'precision', 'recall', 'f1', 'log_loss'))}
    from {_AUC.format(c='proba_' + m)} a, (select {_sql_metrics('proba_' + m)} from pred where is_home_win is not null) b""" for m in "abc")))
def m21(spark, sf_dir):
    return rounded(metrics.compare_models(fx.pred(spark, sf_dir), "is_home_win"))


_ATTR = ["fg_home", "ast_home", "tov_home", "fg_guest", "ast_guest", "tov_guest"]


@query("m25_importance_table", with_sql("box", "select * from (" + " union all ".join(
    f"select '{c}' as feature, round(avg(abs({c} - m.{c})), 6) as mean_abs from box, (select avg({c}) as {c} from box) m"
    .replace(f"avg(abs({c} - m.{c}))", f"avg(abs(box.{c} - m.{c}))") for c in _ATTR) + ") x order by mean_abs desc limit 4"))
def m25(spark, sf_dir):
    box = fx.box(spark, sf_dir).select(*_ATTR)
    means = F.broadcast(box.agg(*[F.avg(c).alias(f"m_{c}") for c in _ATTR]))  # one row
    centred = box.join(means).select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in _ATTR])
    return rounded(attribution.importance_table(centred, _ATTR, top=4))


@query("m28_backfill_outcomes", with_sql("games pred", """select game_id, pts_home > pts_guest as is_home_win, round(proba_a, 6) as proba_a
    from (select game_id, proba_a from pred where game_id % 3 = 0) p join (select game_id, pts_home, pts_guest from games) g using (game_id)
    where pts_home is not null"""))
def m28(spark, sf_dir):
    scored = fx.pred(spark, sf_dir).select("game_id", "is_home_win", "proba_a")
    is_open = F.col("game_id") % 3 == 0  # stored predictions, a third of them made before the game
    stored = scored.withColumn("is_home_win", F.when(~is_open, F.col("is_home_win")))
    return rounded(scoring.backfilled(stored, fx.games(spark, sf_dir)))


@query("m30_metric_registry", with_sql("pred", """select round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(log_loss, 6) as log_loss,
    round(-log_loss, 6) as neg_log_loss, round(brier, 6) as brier_score, round(f1w, 6) as f1_weighted from
    (select """ + _sql_metrics("proba_c") + """, avg(pow(proba_c - cast(is_home_win as int), 2)) as brier from pred) a,
    (select (2*tp/(2*tp + fp + fn)*(tp + fn) + 2*tn/(2*tn + fn + fp)*(tn + fp)) / (tp + fp + fn + tn) as f1w from
      (select count(*) filter (proba_c >= 0.5 and is_home_win) as tp, count(*) filter (proba_c >= 0.5 and not is_home_win) as fp,
       count(*) filter (proba_c < 0.5 and is_home_win) as fn, count(*) filter (proba_c < 0.5 and not is_home_win) as tn from pred) c) b"""))
def m30(spark, sf_dir):
    return rounded(metrics.evaluate(fx.pred(spark, sf_dir), "is_home_win", "proba_c",
                                    ["accuracy", "f1", "log_loss", "neg_log_loss", "brier_score", "f1_weighted"]))
