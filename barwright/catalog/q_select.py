"""Screening, selection, splits, the window index and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.catalog.base import (BASE_D, HORIZON, KEY, PANEL_D, PREDS, ROWS, TRAIN, Tables, avg_rank, clip_sql, i, ic_sql, m_, out, pct_rank, query, r, rs,
                                    train_rows, uniform_sql, w_, z_sql)
from barwright.catalog.q_features import EV, LADDER, ladder
from barwright.operators import factors, features, labels, sampling, select, splits, views
from barwright.plans.moments import Stats, gram
from barwright.plans.staging import stage

P = ("p1", "p2", "p3")
FACTORS = ("mom_5", "mom_21", "rv_5", "rv_21", "bollz_5", "bollz_21", "rsi_21")
_f = {"mom": "sum(lr) OVER {f}", "rv": "sqrt(sum(lr * lr) OVER {f})", "bollz": "(close - avg(close) OVER {f}) / (stddev_samp(close) OVER {f} + 1e-9)",
      "rsi": "100 - 100 / (1 + avg(up) OVER {f} / (avg(dn) OVER {f} + 1e-9))"}
FP = BASE_D + ", fp AS (SELECT symbol, datetime, strftime(datetime, '%Y-%m') AS month, label, " + ", ".join(
    f"coalesce({m_(_f[n.split('_')[0]].format(f=w_(int(n.split('_')[1]))), int(n.split('_')[1]))}, 0) AS {n}" for n in FACTORS) + " FROM base WHERE TRUE)"


def panel_factors(t: Tables):
    """The factor frame of the screening queries, written once per session."""
    if "fp" not in t.__dict__:
        f = factors.factor_panel(t.d, ["mom", "rv", "bollz", "rsi"], (5, 21), keep=("symbol", "datetime", "label"), rows=ROWS)
        t.__dict__["fp"] = stage(f.select("symbol", "datetime", "label", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in FACTORS]), "factors")
    return t.__dict__["fp"]


def _screen(name: str, where: str = "label IS NOT NULL", key: str = "") -> str:
    return (f"SELECT '{name}' AS factor, sum({name} * label) / sqrt(sum({name} * {name}) * sum(label * label)) AS ic, avg((abs({name}) > 0)::INT) AS coverage, count(*) AS n"
            f"{key} FROM fp WHERE {where}")


SCREEN = "sc AS (" + " UNION ALL ".join(_screen(n) for n in FACTORS) + ")"


@query("fs01_screen", f"WITH {FP}, {SCREEN} SELECT factor, {r('ic', 'ic', 6)}, {r('coverage', 'coverage', 6)}, n FROM sc WHERE coverage >= 0.3")
def _(t: Tables):
    return out(select.screen(panel_factors(t), FACTORS), ("ic", "coverage", "n"), ("factor",), 6)


@query("fs02_view_budget", f"""WITH {FP}, {SCREEN}, o AS (SELECT *, row_number() OVER (ORDER BY abs(ic) DESC, factor) AS place FROM sc WHERE coverage >= 0.3)
   SELECT factor, {r('ic', 'ic', 6)}, place, v.view FROM o JOIN (VALUES ('tsz', 2), ('csz', 4), ('csr', 4)) v(view, lim) ON place <= lim""")
def _(t: Tables):
    return out(select.view_budget(select.screen(panel_factors(t), FACTORS), {"tsz": 2, "csz": 4, "csr": 4}), ("ic", "place"), ("factor", "view"), 6)


PAIRS = [(a, b) for k, a in enumerate(FACTORS) for b in FACTORS[k + 1:]]


@query("fs03_correlations", f"WITH {FP} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM fp WHERE label IS NOT NULL" for a, b in PAIRS))
def _(t: Tables):
    return out(select.correlation_long(panel_factors(t), FACTORS), ("corr",), ("a", "b"), 6)


def _stats(t: Tables, where=None, cols=FACTORS) -> Stats:
    d = panel_factors(t) if cols is FACTORS else t.preds
    return Stats.of(gram(d.where(where) if where is not None else d, [], list(cols), "label").head())


def _names(t: Tables, rows: list[tuple], schema: str):
    """A k-row result of a driver decision as a frame."""
    return t.spark.createDataFrame(rows, schema)


@query("fs03_greedy_decorrelation")
def _(t: Tables):
    return _names(t, [(k + 1, n) for k, n in enumerate(select.greedy_decorrelate(_stats(t), FACTORS, 0.9))], "pos long, factor string")


@query("fs04_decorrelated_library")
def _(t: Tables):
    return _names(t, [(k + 1, n) for k, n in enumerate(select.greedy_decorrelate(_stats(t, train_rows()), FACTORS, 0.92, top=4))], "pos long, factor string")


def _yearly(n: str) -> str:
    return (f"SELECT '{n}' AS factor, avg(ic) AS mean_ic, avg(abs(ic)) AS mean_abs_ic, stddev_pop(ic) AS std_ic, avg((sign(ic) = s)::INT) AS sign_hit, any_value(o) AS overall_ic FROM "
            f"(SELECT ic, o, CASE WHEN sign(avg(ic) OVER ()) = 0 THEN 1 ELSE sign(avg(ic) OVER ()) END AS s FROM (SELECT month, sum({n} * label) / sqrt(greatest(sum({n} * {n}) * sum(label * label), 1e-24)) AS ic, "
            f"(SELECT sum({n} * label) / sqrt(sum({n} * {n}) * sum(label * label)) FROM fp WHERE label IS NOT NULL) AS o FROM fp WHERE label IS NOT NULL GROUP BY month))")


@query("fs05_yearly_score", f"WITH {FP}, y AS ({' UNION ALL '.join(_yearly(n) for n in FACTORS)}) SELECT factor, {rs(('mean_ic', 'mean_abs_ic', 'std_ic', 'sign_hit', 'overall_ic'), 5)}, "
       f"{r('abs(mean_ic) + 0.25 * abs(overall_ic) + 0.10 * mean_abs_ic + 0.02 * sign_hit - 0.05 * std_ic', 'score', 5)} FROM y")
def _(t: Tables):
    return out(select.yearly_score(panel_factors(t), FACTORS), ("mean_ic", "mean_abs_ic", "std_ic", "sign_hit", "overall_ic", "score"), ("factor",), 5)


@query("fs06_ridge_stepwise")
def _(t: Tables):
    rows = select.ridge_stepwise(_stats(t, train_rows()), _stats(t, ~train_rows()), (1, 2, 4, 7), 1.0)
    return _names(t, [(k, float(v)) for k, v in rows], "k long, val_ic double")


@query("fs07_leave_one_out")
def _(t: Tables):
    return out(select.leave_one_out(panel_factors(t).where(F.col("label").isNotNull()), t.g, FACTORS, train_rows()), ("base_ic", "drop_ic", "delta_ic", "retained"), ("factor",), 9)


@query("fs08_noise_importance")
def _(t: Tables):
    s = _stats(t, train_rows())
    return select.noise_importance(panel_factors(t).where(F.col("label").isNotNull() & ~train_rows()), FACTORS, select.ridge_weights(s, 1.0))


def _solo(n: str) -> str:
    a, b = (f"sum({n} * label) FILTER (WHERE {c}) / sqrt(sum({n} * {n}) FILTER (WHERE {c}) * sum(label * label) FILTER (WHERE {c}))" for c in (TRAIN, f"NOT ({TRAIN})"))
    return f"SELECT '{n}' AS factor, round({a}, 6) AS train_ic, round({b}, 6) AS val_ic FROM fp WHERE label IS NOT NULL"


@query("fs09_standalone", f"WITH {FP} " + " UNION ALL ".join(_solo(n) for n in FACTORS))
def _(t: Tables):
    return out(select.standalone(panel_factors(t), FACTORS, train_rows()), ("train_ic", "val_ic"), ("factor",), 6)


@query("fs10_greedy_forward")
def _(t: Tables):
    return _names(t, [(k + 1, n) for k, n in enumerate(select.greedy_forward(_stats(t, train_rows()), FACTORS, 4, 0.02))], "pos long, factor string")


@query("fs11_component_rank")
def _(t: Tables):
    w = select.ridge_weights(_stats(t, train_rows()).standardised(), 1.0)
    table = _names(t, [(n, float(v)) for n, v in zip(FACTORS, w)], "factor string, weight double")
    return select.component_rank(table, select.standalone(panel_factors(t), FACTORS, train_rows()))


@query("fs12_name_subset", f"WITH {FP}, {SCREEN} SELECT factor, {r('ic', 'ic', 6)} FROM sc WHERE suffix(factor, '_21') AND contains(factor, 'm')")
def _(t: Tables):
    return out(select.name_subset(select.factor_scores(panel_factors(t), FACTORS), suffix="_21", has="m"), ("ic",), ("factor",), 6)


@query("fs13_top_features", f"WITH {FP}, {SCREEN} SELECT factor, {r('ic', 'delta_ic', 6)} FROM sc WHERE coverage >= 0.3 ORDER BY ic DESC, factor LIMIT 3")
def _(t: Tables):
    d = select.screen(panel_factors(t), FACTORS).select("factor", F.col("ic").alias("delta_ic"))
    return out(select.top_features(d, 3), ("delta_ic",), ("factor",), 6)


@query("tf11_top_operators", f"""WITH {FP}, q AS ({' UNION ALL '.join(_screen(n, "label IS NOT NULL AND month < '1999-01'", ", month") + ' GROUP BY month' for n in FACTORS)}),
   s AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY abs(ic) DESC, factor) AS pos FROM q) SELECT month, factor, {r('ic', 'ic', 5)}, pos FROM s WHERE pos <= 3""")
def _(t: Tables):
    d = panel_factors(t).withColumn("month", F.date_format("datetime", "yyyy-MM")).where("month < '1999-01'")
    return out(features.top_operators(select.factor_scores(d, FACTORS, keys=["month"]), ["month"], "ic", 3), ("ic", "pos"), ("month", "factor"), 5)


# ---- splits -----------------------------------------------------------------------------------------------
SPLIT = """sp0 AS (SELECT min(datetime)::DATE AS d0, max(datetime)::DATE AS d1 FROM bars), sp1 AS (SELECT d0, d1, unnest(generate_series((date_trunc('month', d0) + INTERVAL 12 MONTH)::TIMESTAMP, d1::TIMESTAMP, INTERVAL {k} MONTH))::DATE AS es FROM sp0),
   sp AS (SELECT *, least((es + INTERVAL {k} MONTH)::DATE, d1 + 1) AS ee, (d1 + 1) < (es + INTERVAL {k} MONTH)::DATE AS part FROM sp1)"""
COUNTS = "(SELECT count(*) FROM panel WHERE label IS NOT NULL AND datetime >= {a} AND datetime < {b})"


def _with_counts(t: Tables, s):
    n = splits.split_rows(t.d, s, F.col("label").isNotNull())
    return s.join(n, "split").select("split", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "eval_start", "eval_end")], "n_train", "n_eval")


@query("sp01_monthly_splits", f"""WITH {PANEL_D}, {SPLIT.format(k=1)} SELECT strftime(es, '%Y-%m') || CASE WHEN part THEN '_partial' ELSE '' END AS split, d0::VARCHAR AS train_start, (es - 1)::VARCHAR AS train_end, es::VARCHAR AS eval_start, ee::VARCHAR AS eval_end,
   {COUNTS.format(a='d0', b='es - 1')} AS n_train, {COUNTS.format(a='es', b='ee')} AS n_eval FROM sp""")
def _(t: Tables):
    return _with_counts(t, splits.month_splits(t.d, 1, 1))


@query("sp02_representative", f"WITH {PANEL_D}, {SPLIT.format(k=1)} SELECT strftime(es, '%Y-%m') || CASE WHEN part THEN '_partial' ELSE '' END AS split, (es - 1)::VARCHAR AS train_end FROM sp WHERE month(es) IN (1, 4, 7, 10, 12)")
def _(t: Tables):
    return splits.representative(splits.month_splits(t.d, 1, 1), (1, 4, 7, 10, 12)).select("split", F.col("train_end").cast("string").alias("train_end"))


@query("sp03_quarterly_splits", f"""WITH {PANEL_D}, {SPLIT.format(k=3)} SELECT strftime(es, '%Y') || 'Q' || quarter(es) || CASE WHEN part THEN '_partial' ELSE '' END AS split, d0::VARCHAR AS train_start, es::VARCHAR AS train_end, es::VARCHAR AS eval_start, ee::VARCHAR AS eval_end,
   {COUNTS.format(a='d0', b='es')} AS n_train, {COUNTS.format(a='es', b='ee')} AS n_eval FROM sp""")
def _(t: Tables):
    return _with_counts(t, splits.month_splits(t.d, 3, 0))


@query("sp04_outer_folds", """WITH m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem WHERE year(l_shipdate) = 1999),
   f AS (SELECT * FROM (VALUES ('q2', '1999-04', '1999-06'), ('q3', '1999-07', '1999-09'), ('q4', '1999-10', '1999-12'), ('h2', '1999-07', '1999-12')) v(fold, v0, v1)),
   x AS (SELECT *, row_number() OVER (PARTITION BY fold, month < v0 ORDER BY month DESC) AS k FROM f, m)
   SELECT fold, month, CASE WHEN month < v0 THEN 'fit' ELSE 'validate' END AS role FROM x WHERE (month < v0 AND k <= 6) OR (month BETWEEN v0 AND v1)""")
def _(t: Tables):
    return splits.outer_folds(t.d, 1999, "last6")


@query("sp05_first_bar_embargo", f"""WITH {PANEL_D}, f AS (SELECT symbol, min(bar_no) AS cut FROM panel WHERE strftime(datetime, '%Y-%m') = '1999-03' GROUP BY symbol)
   SELECT {KEY}, {r('label')} FROM panel LEFT JOIN f USING (symbol) WHERE strftime(datetime, '%Y-%m') < '1999-03' AND datetime >= TIMESTAMP '1997-01-01' AND (cut IS NULL OR bar_no < cut - 5) AND label IS NOT NULL""")
def _(t: Tables):
    return out(splits.embargo_before_month(t.d, "1999-03", 5, "1997-01-01").where("label is not null"), ("label",))


@query("sp06_month_end_embargo", f"""WITH {PANEL_D}, k AS (SELECT *, strftime(datetime, '%Y-%m') AS m, row_number() OVER (PARTITION BY symbol, strftime(datetime, '%Y-%m') ORDER BY datetime DESC) - 1 AS bte FROM panel)
   SELECT {KEY}, {i('bte', 'bars_to_month_end')} FROM k WHERE m < '1999-03' AND m >= '1998-03' AND (m <> '1999-02' OR bte >= 6)""")
def _(t: Tables):
    return out(splits.month_end_embargo(t.d, "1999-03", 6, 12), ("bars_to_month_end",))


@query("sp07_three_way", f"""WITH {PANEL_D}, {SPLIT.format(k=3)}, w AS (SELECT strftime(es, '%Y') || 'Q' || quarter(es) || CASE WHEN part THEN '_partial' ELSE '' END AS split, d0, greatest(d0, (es - INTERVAL 6 MONTH)::DATE) AS vs, es, ee FROM sp)
   SELECT split, d0::VARCHAR AS train_start, (vs - 2)::VARCHAR AS train_end, vs::VARCHAR AS val_start, (es - 2)::VARCHAR AS val_end, es::VARCHAR AS test_start, ee::VARCHAR AS test_end FROM w""")
def _(t: Tables):
    s = splits.three_way(splits.month_splits(t.d, 3, 0), 6, 2)
    return s.select("split", *[F.col(c).cast("string").alias(c) for c in s.columns if c != "split"])


@query("wn01_window_index", f"""WITH {PANEL_D} SELECT {KEY}, {i('bar_no')}, {i('session_pos')} FROM panel WHERE datetime >= TIMESTAMP '1996-01-01' AND datetime < TIMESTAMP '2000-01-01'
   AND session_pos >= 7 AND session_pos % 2 = 0 AND label IS NOT NULL""")
def _(t: Tables):
    return out(splits.window_index(t.d, 8, "1996-01-01", "2000-01-01", stride=2), ("bar_no", "session_pos"))


@query("wn01_window_index_symbol", f"WITH {PANEL_D} SELECT {KEY}, {i('bar_no')} FROM panel WHERE datetime >= TIMESTAMP '1995-01-01' AND datetime < TIMESTAMP '1996-01-01' AND bar_no >= 7 AND bar_no % 3 = 0 AND label IS NOT NULL")
def _(t: Tables):
    return out(splits.window_index(t.d, 8, "1995-01-01", "1996-01-01", stride=3, scope="symbol"), ("bar_no",))


@query("wn02_windows", f"""WITH {PANEL_D}, x AS (SELECT *, list(volume) OVER f AS v, list(oi) OVER f AS o FROM panel WINDOW f AS (PARTITION BY symbol, session_id ORDER BY datetime ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
   SELECT {KEY}, 8::BIGINT AS length, {i('8 - len(v)', 'padded')}, {r('list_sum(v)', 'sum_volume')}, {r('CASE WHEN len(o) = 8 THEN o[1] ELSE 0 END', 'first_oi')}, {r('v[len(v)]', 'last_volume')} FROM x WHERE label IS NOT NULL""")
def _(t: Tables):
    w = splits.materialise_windows(t.d, ("volume", "oi"), 8, F.col("label").isNotNull(), rows=ROWS)
    w = w.select("symbol", "datetime", F.size("window").alias("length"), F.greatest(F.lit(7) - F.col("session_pos"), F.lit(0)).alias("padded"),
                 F.aggregate("window", F.lit(0.0), lambda a, s: a + s["volume"]).alias("sum_volume"), F.element_at("window", 1)["oi"].alias("first_oi"),
                 F.element_at("window", -1)["volume"].alias("last_volume"))
    return out(w, ("length", "padded", "sum_volume", "first_oi", "last_volume"))


@query("wn02_strided", f"""WITH {PANEL_D}, x AS (SELECT *, list(volume) OVER f AS v, list(oi) OVER f AS o FROM panel WINDOW f AS (PARTITION BY symbol, session_id ORDER BY datetime ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
   SELECT {KEY}, {i('session_pos')}, {i('30 - len(v)', 'padded')}, {r('list_sum(v)', 'sum_volume')}, {r('CASE WHEN len(o) = 30 THEN o[1] ELSE 0 END', 'first_oi')}, {r('v[len(v)]', 'last_volume')} FROM x WHERE label IS NOT NULL AND session_pos % 12 = 0""")
def _(t: Tables):
    w = splits.strided_windows(t.d, ("volume", "oi"), 30, 12, F.col("label").isNotNull())
    w = w.select("symbol", "datetime", "session_pos", F.greatest(F.lit(29) - F.col("session_pos"), F.lit(0)).alias("padded"),
                 F.aggregate("window", F.lit(0.0), lambda a, s: a + s["volume"]).alias("sum_volume"), F.element_at("window", 1)["oi"].alias("first_oi"),
                 F.element_at("window", -1)["volume"].alias("last_volume"))
    return out(w, ("session_pos", "padded", "sum_volume", "first_oi", "last_volume"))


@query("wn03_train_scale", f"WITH {PREDS}, s AS (SELECT avg(label) AS m, stddev_pop(label) AS s FROM preds WHERE {TRAIN}) SELECT {KEY}, {r('(label - m) / greatest(s, 1e-8)', 'target_z')} FROM preds, s")
def _(t: Tables):
    return out(splits.train_scale(t.preds, "label", train_rows()), ("target_z",))


@query("wn04_predictions_back", f"WITH {PANEL_D} SELECT {KEY}, {r('label')}, {r('volume * 0.5', 'pred')} FROM panel WHERE session_pos >= 3 AND volume > 20 AND label IS NOT NULL")
def _(t: Tables):
    preds = splits.window_index(t.d, 4, "1900-01-01", "2100-01-01").select("symbol", "bar_no", (F.col("volume") * 0.5).alias("pred"))
    return out(splits.predictions_to_frame(t.d.withColumn("ok", F.col("volume") > 20), preds, "ok"), ("label", "pred"))


# ---- sampling ---------------------------------------------------------------------------------------------
DT = "strftime(datetime, '%Y-%m-%d %H:%M')"


def u(seed: int) -> str:
    return uniform_sql(seed, "symbol", DT)


SAMPLE = LADDER + f", lv AS (SELECT symbol, datetime, label, {pct_rank('label', 'datetime')} - 0.5 AS label_xrank, {EV} AS event_score FROM ladder), pool AS (SELECT *, strftime(datetime, '%Y-%m') AS month FROM lv WHERE label IS NOT NULL)"


def pool(t: Tables):
    if "pool" not in t.__dict__:
        d = views.event_score(labels.label_views(ladder(t), t.g), t.g, {"ret1": 1.0, "range_rel": 1.0, "log_amount": 0.65, "oi_chg": 0.35})
        t.__dict__["pool"] = stage(d.where("label is not null").select("symbol", "datetime", "label", "label_xrank", "event_score"), "pool")
    return t.__dict__["pool"]


def picked(d):
    return out(d, ("label",))


@query("sm01_cap_rows", f"WITH {SAMPLE} SELECT {KEY}, {r('label')} FROM pool ORDER BY {u(7)}, symbol, datetime LIMIT 5000")
def _(t: Tables):
    return picked(sampling.cap_rows(pool(t), 5000, 7))


def wdraw(seed: int, w: str) -> str:
    return f"(-ln(greatest({u(seed)}, 1e-12)) / ({w}))"


EW = "sqrt(greatest(coalesce(event_score, 0), 0) + 0.05)"


def strat_sql(src: str, n: str, per: str, stratum: str, seed: int, fill: str, tag: str = "") -> str:
    """Quota per stratum, then the lowest fill scores."""
    return (f"q1{tag} AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {u(seed)}, symbol, datetime) AS k FROM {src}), "
            f"q2{tag} AS (SELECT *, k <= {per} AS inq FROM q1{tag}), "
            f"q3{tag} AS (SELECT *, row_number() OVER (PARTITION BY inq ORDER BY {fill}, symbol, datetime) AS f FROM q2{tag}), "
            f"strat{tag} AS (SELECT symbol, datetime, label FROM q3{tag} WHERE inq OR f <= {n} - (SELECT count(*) FROM q2{tag} WHERE inq))")


B8 = "least(greatest(floor((label_xrank + 0.5) * 8), 0), 7)"
B6 = "least(greatest(floor((label_xrank + 0.5) * 6), 0), 5)"


@query("sm02_stratified", f"WITH {SAMPLE}, {strat_sql('pool', '4000', '500', B8, 3, u(4))} SELECT {KEY}, {r('label')} FROM strat")
def _(t: Tables):
    return picked(sampling.stratified(pool(t), 4000, 3))


NS6 = f"(SELECT count(DISTINCT month || '/' || ({B6})) FROM pool)"


@query("sm03_stratified_months", f"WITH {SAMPLE}, {strat_sql('pool', '4000', f'greatest(1, 4000 // {NS6})', f'month, {B6}', 5, u(6))} SELECT {KEY}, {r('label')} FROM strat")
def _(t: Tables):
    return picked(sampling.stratified_months(pool(t), 4000, 5))


@query("sm03_weighted_fill", f"WITH {SAMPLE}, {strat_sql('pool', '4000', f'greatest(1, 4000 // {NS6})', f'month, {B6}', 5, wdraw(6, EW))} SELECT {KEY}, {r('label')} FROM strat")
def _(t: Tables):
    return picked(sampling.stratified_months(pool(t), 4000, 5, weighted_fill=True))


@query("sm04_soft_event", f"""WITH {SAMPLE}, e AS (SELECT *, row_number() OVER (ORDER BY {wdraw(9, EW)}, symbol, datetime) AS ke FROM pool), rest AS (SELECT * FROM e WHERE ke > 1000),
   {strat_sql('rest', '3000', '375', B8, 16, u(17))} SELECT {KEY}, {r('label')} FROM (SELECT symbol, datetime, label FROM e WHERE ke <= 1000 UNION ALL SELECT * FROM strat)""")
def _(t: Tables):
    return picked(sampling.soft_event(pool(t), 4000, 9))


@query("sm05_event_tail", f"""WITH {SAMPLE}, c AS (SELECT quantile_cont(event_score, 0.72) AS q FROM pool), e AS (SELECT pool.*, event_score >= q AS hi, row_number() OVER (PARTITION BY event_score >= q ORDER BY event_score DESC, symbol, datetime) AS ke FROM pool, c),
   rest AS (SELECT * FROM e WHERE NOT (hi AND ke <= 2800)), g AS (SELECT count(*) AS g FROM e WHERE hi AND ke <= 2800),
   {strat_sql('rest', '(SELECT 4000 - g FROM g)', f"greatest(1, (SELECT (4000 - g) FROM g) // (SELECT count(DISTINCT month || '/' || ({B6})) FROM rest))", f'month, {B6}', 11, wdraw(12, EW))}
   SELECT {KEY}, {r('label')} FROM (SELECT symbol, datetime, label FROM e WHERE hi AND ke <= 2800 UNION ALL SELECT * FROM strat)""")
def _(t: Tables):
    return picked(sampling.event_tail(pool(t), 4000, 11))


@query("sm06_recency", f"""WITH {SAMPLE}, w AS (SELECT *, greatest(exp(-ln(2) * date_diff('second', datetime, max(datetime) OVER ()) / 86400.0 / 200), 1e-12) AS w FROM pool)
   SELECT {KEY}, {r('label')} FROM w ORDER BY {wdraw(13, 'w')}, symbol, datetime LIMIT 3000""")
def _(t: Tables):
    return picked(sampling.recency_sample(pool(t), 3000, 13, 200.0))


@query("sm07_whole_timestamps", f"""WITH RECURSIVE {SAMPLE}, ts AS (SELECT datetime, count(*) AS n FROM pool GROUP BY datetime HAVING count(*) >= 8),
   o AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(15, DT)}, datetime) AS k FROM ts),
   walk(k, used, datetime) AS (SELECT 0::BIGINT, 0::HUGEINT, NULL::TIMESTAMP UNION ALL
     SELECT o.k, CASE WHEN used = 0 OR used + n <= 3000 THEN used + n ELSE used END, CASE WHEN used = 0 OR used + n <= 3000 THEN o.datetime END FROM walk w JOIN o ON o.k = w.k + 1)
   SELECT {KEY}, {r('label')} FROM pool WHERE datetime IN (SELECT datetime FROM walk)""")
def _(t: Tables):
    return picked(sampling.whole_timestamps(pool(t), 3000, 8, 15))


@query("sm08_timestamp_batches", f"""WITH {SAMPLE}, ts AS (SELECT datetime, (row_number() OVER (ORDER BY {uniform_sql(17, DT)}, datetime) - 1) // 16 AS batch FROM (SELECT datetime FROM pool GROUP BY datetime HAVING count(*) >= 8)),
   k AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY {u(18)}, symbol) AS k FROM pool) SELECT {KEY}, {r('label')}, {i('batch')} FROM k JOIN ts USING (datetime) WHERE k <= 6""")
def _(t: Tables):
    return out(sampling.timestamp_batches(pool(t), t.g, 16, 6, 8, 17), ("label", "batch"))


@query("sm09_month_weights", f"WITH {PREDS} SELECT {KEY}, {r('exp(-ln(2) * (2001 * 12 + 6 - year(datetime) * 12 - month(datetime)) / 9.0)', 'weight', 6)} FROM preds WHERE month < '2001-06'")
def _(t: Tables):
    return out(sampling.month_weights(t.preds.where("month < '2001-06'"), "2001-06", 9.0), ("weight",), digits=6)


@query("sm09_day_weights", f"""WITH {PREDS}, w AS (SELECT *, least(greatest(exp(-ln(2) * greatest(date_diff('second', datetime, TIMESTAMP '2001-12-01') / 86400.0, 0) / 300), 0.05), 0.9) AS w FROM preds)
   SELECT {KEY}, {r('w / (SELECT avg(w) FROM w)', 'weight', 5)} FROM w""")
def _(t: Tables):
    return out(sampling.day_weights(t.preds, "2001-12-01", 300.0, 0.05, 0.9), ("weight",), digits=5)
