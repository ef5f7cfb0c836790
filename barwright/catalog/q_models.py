"""Linear models, calibration, blends, memory and guards."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from barwright.catalog.base import (BASE_D, COMPONENTS, KEY, PANEL_D, PANEL_H, PREDS, ROWS, TRAIN, Tables, clip_sql, i, ic_sql, m_, out, pct_rank, query, r, rs, train_rows, w_, z_sql)
from barwright.catalog.q_select import _names
from barwright.operators import blend, calibrate as cal, evaluate as ev, factors, labels, linear, memory, relational as rel, sampling, select, splits, views
from barwright.plans.moments import Stats, gram, score

P = list(COMPONENTS)
c_ = F.col


def row_stats(t: Tables, where=None, cols=P) -> Stats:
    d = t.preds if where is None else t.preds.where(where)
    return Stats.of(gram(d, [], cols, "label").head())


def preds_out(d, col: str = "pred"):
    return out(d.withColumn("pred_out", c_(col)), ("label", "pred_out"))


# ---- models (checked in tests against NumPy on fixtures) ----------------------------------------------
@query("md01_weighted_ridge")
def _(t: Tables):
    w = F.pow(F.lit(0.5), (F.lit(1999) - F.year("datetime")).cast("double"))
    return preds_out(linear.weighted_ridge(t.preds, train_rows(), P, alpha=5.0, weight=w, top_k=2, bound=4.0))


def sums3(src: str, keys: str = "", where: str = "") -> str:
    """SQL for the additive statistics of three components, per ``keys``."""
    cells = [f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(P, 1) for j, b in enumerate(P, 1) if i <= j]
    cols = ["count(*)::DOUBLE AS n", "sum(label) AS sy", *[f"sum({x}) AS s{i}" for i, x in enumerate(P, 1)], *[f"sum({x} * label) AS c{i}" for i, x in enumerate(P, 1)], *cells]
    return f"SELECT {keys + ', ' if keys else ''}{', '.join(cols)} FROM {src} {where} {'GROUP BY ' + keys if keys else ''}"


STATS3 = ["n", "sy", *[f"{k}{i}" for k in "sc" for i in (1, 2, 3)], "g11", "g12", "g13", "g22", "g23", "g33"]


def ridge3_sql(src: str, alpha: float, keys: str = "", per_row: bool = False, intercept: bool = True, bound: float = 1e300) -> str:
    """SQL for a ridge of three components by Cramer's rule: w1, w2, w3, b from a table of ``sums3`` columns."""
    k = keys + ", " if keys else ""
    if intercept:
        m = ", ".join(f"s{i} / n AS m{i}, sqrt(g{i}{i} / n - (s{i} / n) * (s{i} / n)) AS d{i}" for i in (1, 2, 3))
        z = ", ".join([f"(g{i}{j} - n * m{i} * m{j}) / (d{i} * d{j}) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"(c{i} - m{i} * sy) / d{i} AS v{i}" for i in (1, 2, 3)])
    else:
        m = ", ".join(f"0.0 AS m{i}, 1.0 AS d{i}" for i in (1, 2, 3))
        z = ", ".join([f"g{i}{j} AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"c{i} AS v{i}" for i in (1, 2, 3)])
    by = "n" if per_row else "1.0"
    e = ", ".join([f"a{i}{j} / {by} + {alpha if i == j else 0.0} AS e{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"v{i} / {by} AS u{i}" for i in (1, 2, 3)])

    def det(put: int = 0) -> str:
        x = {(r, c): f"u{r}" if c == put else f"e{min(r, c)}{max(r, c)}" for r in (1, 2, 3) for c in (1, 2, 3)}
        return " + ".join(f"{x[1, a]} * ({x[2, b]} * {x[3, c]} - {x[2, c]} * {x[3, b]})" for a, b, c in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))

    w = ", ".join(f"least(greatest(({det(i)}) / ({det()}), -{bound}), {bound}) / d{i} AS w{i}" for i in (1, 2, 3))
    b = "sy / n - w1 * m1 - w2 * m2 - w3 * m3" if intercept else "0.0"
    return (f"SELECT *, {b} AS b FROM (SELECT {k}n, sy, m1, m2, m3, {w} FROM (SELECT {k}n, sy, m1, m2, m3, d1, d2, d3, {e} FROM "
            f"(SELECT {k}n, sy, m1, m2, m3, d1, d2, d3, {z} FROM (SELECT *, {m} FROM {src}))))")


def past_sql(name: str, src: str, lookback: int, by: str = "") -> str:
    """SQL for sums over the ``lookback`` distinct months before each month that ``preds`` has (per ``by``)."""
    add = ", ".join(f"sum(o.{c}) AS {c}" for c in STATS3)
    k, on = (f", t.{by}", f" AND o.{by} = t.{by}") if by else ("", "")
    return (f"mi AS (SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM preds)), "
            if name == "past" else "") + (
        f"{name} AS (SELECT t.month{k}, {add} FROM (SELECT DISTINCT month{', ' + by if by else ''} FROM preds) t JOIN mi a ON a.month = t.month "
        f"JOIN mi z ON z.i BETWEEN a.i - {lookback} AND a.i - 1 JOIN {src} o ON o.month = z.month{on} GROUP BY t.month{k})")


DOT3 = "{t}.b + {t}.w1 * p1 + {t}.w2 * p2 + {t}.w3 * p3"


@query("md02_ridge_variants", f"""WITH {PREDS}, st AS ({sums3('preds', where='WHERE ' + TRAIN)}), a AS ({ridge3_sql('st', 0.1, per_row=True)}),
   z AS ({ridge3_sql('st', 10.0, intercept=False)}) SELECT {KEY}, {r(DOT3.format(t='a'), 'signed')}, {r(DOT3.format(t='z'), 'raw_gram')} FROM preds, a, z""")
def _(t: Tables):
    d = t.preds
    for name, solver in (("signed", linear.ridge(0.1, per_row=True)), ("raw_gram", linear.ridge(10.0, intercept=False))):
        w, b = linear.fit(d.where(train_rows()), P, "label", solver)
        d = d.withColumn(name, score(P, w, b))
    return out(d, ("signed", "raw_gram"))


@query("md03_rank_gauss_ridge")
def _(t: Tables):
    return preds_out(linear.rank_gauss_ridge(t.preds, train_rows(), P, n=101))


@query("md04_walk_forward", f"""WITH {PREDS}, ms AS ({sums3('preds', 'month')}), {past_sql('past', 'ms', 24)}, f AS ({ridge3_sql('past', 10.0, 'month')})
   SELECT {KEY}, {r('label')}, {r(DOT3.format(t='f'), 'pred_out')} FROM preds LEFT JOIN f ON f.month = preds.month AND f.n >= 500""")
def _(t: Tables):
    return preds_out(linear.walk_forward(t.preds, P, linear.ridge(10.0), lookback=24, min_rows=500)[0])


@query("md05_group_experts", f"""WITH {PREDS}, ms AS ({sums3('preds', 'month')}), gs AS ({sums3('preds', 'month, grp')}), {past_sql('past', 'ms', 24)}, {past_sql('gpast', 'gs', 24, 'grp')},
   f AS ({ridge3_sql('past', 10.0, 'month')}), h AS ({ridge3_sql('gpast', 10.0, 'month, grp')})
   SELECT {KEY}, {r('label')}, {r(f"coalesce({DOT3.format(t='h')}, {DOT3.format(t='f')})", 'pred_out')} FROM preds LEFT JOIN f ON f.month = preds.month AND f.n >= 500
   LEFT JOIN h ON h.month = preds.month AND h.grp = preds.grp AND h.n >= 300""")
def _(t: Tables):
    return preds_out(linear.group_experts(t.preds, P, linear.ridge(10.0), "grp", lookback=24, min_rows=500, min_group=300))


@query("md06_boosted_trees")
def _(t: Tables):
    return preds_out(linear.boosted_trees(t.preds, train_rows(), P, cap=20000, rounds=5))


@query("md07_daily_stack_ridge")
def _(t: Tables):
    return preds_out(blend.daily_stack_ridge(t.preds, P, lookback=60, min_days=20))


@query("md08_residual_model")
def _(t: Tables):
    return preds_out(linear.residual_model(t.preds, train_rows(), "p3", ["p1", "p2"]))


@query("md09_linear_calibration", f"""WITH {PREDS}, st AS ({sums3('preds', where='WHERE ' + TRAIN)}), a AS ({ridge3_sql('st', 1e-4, bound=0.5)})
   SELECT {KEY}, {r('label')}, {r(DOT3.format(t='a'), 'pred_out')} FROM preds, a""")
def _(t: Tables):
    return preds_out(linear.linear_calibration(t.preds, train_rows(), P, bound=0.5), "pred_cal")


# ---- calibration --------------------------------------------------------------------------------------
def mult_sql(key: str, x: str, src: str = "preds", k: float = 1000.0, alpha: float = 0.5, tag: str = "") -> str:
    return (f"g{tag} AS (SELECT sum({x} * label) / sum({x} * {x}) AS g FROM {src} WHERE {TRAIN}), "
            f"t{tag} AS (SELECT {key} AS key, sum({x} * label) AS xy, sum({x} * {x}) AS xx, count(*) AS n FROM {src} WHERE {TRAIN} GROUP BY 1), "
            f"mul{tag} AS (SELECT key, n, 1 + {alpha} * (n / (n + {k})) * (least(greatest((xy / xx) / g, 0.5), 1.5) - 1) AS mult FROM t{tag}, g{tag})")


@query("ca01_multiplier", f"WITH {PREDS}, {mult_sql('symbol', 'p3', k=200.0)} SELECT {KEY}, {r('p3 * coalesce(mult, 1)', 'pred_cal')} FROM preds LEFT JOIN mul ON mul.key = preds.symbol")
def _(t: Tables):
    table = cal.fit_multiplier(t.preds.where(train_rows()), "symbol", "p3", k=200.0)
    return out(cal.apply_multiplier(t.preds, table, "symbol", "p3", "pred_cal"), ("pred_cal",))


def edges(x: str, bins: int, where: str = TRAIN, src: str = "preds") -> str:
    return f"(SELECT list_distinct(quantile_cont({x}, [{', '.join(repr(j / bins) for j in range(1, bins))}])) AS e FROM {src} WHERE {where})"


@query("ca02_keys", f"""WITH {PREDS}, e AS {edges('abs(p1)', 6)}, x AS (SELECT *, {pct_rank('p1', 'datetime')} - 0.5 AS xr FROM preds)
   SELECT {KEY}, {i('len(list_filter(e, lambda v: v <= abs(p1)))', 'abs_key')}, {i('len(list_filter(e, lambda v: v <= abs(p1))) * 2 + (p1 >= 0)::INT', 'signed_key')},
   {i('least(floor(abs(xr) * 8), 7)', 'strength')}, {i('floor((hour(datetime) * 60 + minute(datetime)) / 90)', 'time_key')} FROM x, e""")
def _(t: Tables):
    d = cal.abs_key(t.preds, "p1", train_rows(), 6, "abs_key")
    d = cal.abs_key(d, "p1", train_rows(), 6, "signed_key", signed=True)
    d = views.csr(d, t.g, ["p1"], "xr_").withColumns({"strength": cal.strength_key("xr_p1", 8), "time_key": cal.time_key(90)})
    return out(d, ("abs_key", "signed_key", "strength", "time_key"))


@query("ca03_sequential", f"""WITH {PREDS}, e1 AS {edges('abs(p3)', 5)}, k1 AS (SELECT preds.*, len(list_filter(e, lambda v: v <= abs(p3))) * 2 + (p3 >= 0)::INT AS key FROM preds, e1),
   {mult_sql('key', 'p3', 'k1', tag='1')}, s1 AS (SELECT k1.* EXCLUDE (key), p3 * coalesce(mult, 1) AS q FROM k1 LEFT JOIN mul1 USING (key)),
   e2 AS {edges('abs(q)', 4, src='s1')}, k2 AS (SELECT s1.*, len(list_filter(e, lambda v: v <= abs(q))) AS key FROM s1, e2), {mult_sql('key', 'q', 'k2', tag='2')}
   SELECT {KEY}, {r('q * coalesce(mult, 1)', 'pred_cal')} FROM k2 LEFT JOIN mul2 USING (key)""")
def _(t: Tables):
    return out(cal.sequential(t.preds, train_rows(), "p3", [("signed_abs", 5), ("abs", 4)]), ("pred_cal",))


YM = "(substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT)"
AFF = PREDS + f""", ym AS (SELECT *, {YM} AS ti FROM preds), cell AS (SELECT ti, symbol, count(*)::DOUBLE AS n, sum(p3) AS sx, sum(label) AS sy, sum(p3 * p3) AS sxx, sum(p3 * label) AS sxy FROM ym GROUP BY 1, 2),
   per AS (SELECT m.ti, c.symbol, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM (SELECT DISTINCT ti FROM ym) m JOIN cell c ON c.ti < m.ti AND c.ti >= m.ti - 18 GROUP BY 1, 2),
   tot AS (SELECT ti, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM per GROUP BY 1),
   gl AS (SELECT ti, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS gs, (sxx - sx * sx / n) / n AS gv, sy / n AS my, sx / n AS mx FROM tot WHERE n >= 1000),
   glo AS (SELECT *, my - gs * mx AS gi FROM gl),
   par0 AS (SELECT ti, symbol, gs, gi, n, sx, sy, least(greatest((sxy - sx * sy / n + 400 * gv * gs) / (sxx - sx * sx / n + 400 * gv), 0.5), 1.5) AS slope FROM per JOIN glo USING (ti)),
   par AS (SELECT ti, symbol, slope, (n * (sy / n - slope * sx / n) + 300 * gi) / (n + 300) AS icpt FROM par0)"""


@query("ca04_key_affine", f"WITH {AFF} SELECT {KEY}, {r('CASE WHEN gs IS NULL THEN p3 ELSE coalesce(slope, gs) * p3 + coalesce(icpt, gi) END', 'pred_cal')} FROM ym LEFT JOIN glo USING (ti) LEFT JOIN par USING (ti, symbol)")
def _(t: Tables):
    return out(cal.rolling_key_affine(t.preds, ["symbol"], "p3", min_train=1000, output="label"), ("pred_cal",))


@query("ca05_composite_keys", f"""WITH {PREDS}, st AS (SELECT symbol, datetime, (high - low) / close AS state_range, ln(1 + volume) AS state_logvol, close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS ret1s FROM panel),
   j AS (SELECT preds.*, state_range, state_logvol, ret1s FROM preds LEFT JOIN st USING (symbol, datetime)),
   a AS {edges('abs(p1)', 4, src='j')}, b AS {edges('state_range', 3, src='j')}, c AS {edges('state_logvol', 3, src='j')}, d AS {edges('abs(ret1s)', 3, src='j')}
   SELECT {KEY}, CASE WHEN symbol = 'S11' THEN 'unknown' ELSE grp END AS group_key, {i('hour(datetime)', 'hour_key')}, {i('sign(p1)', 'sign_key')}, 0::BIGINT AS tod4_key,
   {', '.join(i(f'coalesce(len(list_filter({e}.e, lambda v: v <= {x})), 0)', n) for e, x, n in (('a', 'abs(p1)', 'conf4_key'), ('b', 'state_range', 'range3_key'), ('c', 'state_logvol', 'vol3_key'), ('d', 'abs(ret1s)', 'ret3_key')))}
   FROM j, a, b, c, d""")
def _(t: Tables):
    d = rel.attach_state(t.preds, t.d, ROWS)
    d, cols = cal.composite_keys(d, ["symbol", "group", "hour", "sign", "tod4", "conf4", "range3", "vol3", "ret3"], "p1", train_rows())
    return out(d, cols[1:])


STATE = "st AS (SELECT symbol, datetime, (high - low) / close AS state_range, ln(1 + volume) AS state_logvol, close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS ret1s FROM panel)"
BIN_SQL = {"conf": "abs({p})", "range": "state_range", "vol": "state_logvol", "ret": "abs(ret1s)"}


def rolling_edges_sql(parts: dict[str, int], p: str, back: int, src: str = "j") -> str:
    """A table e_<part> per binned part: the distinct edges of every time ti that has enough values behind it."""
    tables = []
    for kind, n in parts.items():
        x, probs = BIN_SQL[kind].format(p=p), ", ".join(repr(k / n) for k in range(1, n))
        tables.append(f"e_{kind} AS (SELECT m.ti, list_distinct(quantile_cont({x}, [{probs}])) AS e FROM (SELECT DISTINCT ti FROM {src}) m JOIN {src} b ON b.ti < m.ti AND b.ti >= m.ti - {back} "
                      f"WHERE {x} IS NOT NULL GROUP BY m.ti HAVING count(*) >= {max(1000, 100 * n)})")
    return ", ".join(tables)


def rolling_key_sql(kind: str, p: str) -> str:
    # a quantile between equal values may come out an ulp above them in DuckDB
    return f"coalesce(len(list_filter(e_{kind}.e, lambda v: v <= {BIN_SQL[kind].format(p=p)} + 1e-12)), 0)::BIGINT"


def rolling_keys_sql(parts: dict[str, int], p: str, back: int, ti: str, more: str, src: str) -> str:
    keys = ", ".join(f"{rolling_key_sql(k, p)} AS {k}{n}_key" for k, n in parts.items())
    return (f"{STATE}, j AS (SELECT q.*, state_range, state_logvol, ret1s, {ti} AS ti FROM {src} q LEFT JOIN st USING (symbol, datetime)), {rolling_edges_sql(parts, p, back)} "
            f"SELECT {KEY}, {more}, {keys} FROM j " + " ".join(f"LEFT JOIN e_{k} USING (ti)" for k in parts))


BINS = {"conf": 4, "range": 3, "vol": 3, "ret": 5}
HOURLY = BASE_D.replace(PANEL_D, PANEL_H) + f", hp AS (SELECT * FROM (SELECT symbol, datetime, label, {m_(f'sum(lr) OVER {w_(5)}', 5)} AS p1 FROM base) WHERE p1 IS NOT NULL)"


@query("ca05_rolling_keys", f"WITH {PREDS}, " + rolling_keys_sql(BINS, "p1", 18, YM, f"{i('sign(p1)', 'sign_key')}", "preds"))
def _(t: Tables):
    d = rel.attach_state(t.preds, t.d, ROWS).withColumn("month_no", cal.month_number("month"))
    d, cols = cal.rolling_keys(d, ["sign", "conf4", "range3", "vol3", "ret5"], "p1", "month_no")
    return out(d, cols)


@query("ca05_rolling_keys_hourly", f"WITH {HOURLY}, " + rolling_keys_sql(
    BINS, "p1", 10, "date_diff('day', DATE '1970-01-01', datetime::DATE)",
    f"{i('hour(datetime)', 'hour_key')}, {i('CASE WHEN hour(datetime) <= 10 THEN 0 WHEN hour(datetime) <= 12 THEN 1 WHEN hour(datetime) <= 14 THEN 2 ELSE 3 END', 'tod4_key')}, "
    f"{i('sign(p1)', 'sign_key')}", "hp"))
def _(t: Tables):
    d = factors.factor_panel(t.h, ["mom"], (5,), keep=("symbol", "datetime", "label"), rows=ROWS).withColumnRenamed("mom_5", "p1")
    d = rel.attach_state(d, t.h, ROWS).withColumn("day", F.unix_date(F.to_date("datetime")))
    d, cols = cal.rolling_keys(d.where(F.col("p1").isNotNull()), ["hour", "tod4", "sign", "conf4", "range3", "vol3", "ret5"], "p1", "day", lookback=10)
    return out(d, cols)


RB = {"conf": 4, "range": 3}
RB_KEYS = f"{rolling_key_sql('conf', 'p3')} AS ck, {rolling_key_sql('range', 'p3')} AS rk, sign(p3)::BIGINT AS sk"
RB_SUMS = "sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy"
RB_SQL = f"""{STATE}, j AS (SELECT q.*, state_range, state_logvol, ret1s, {YM} AS ti FROM preds q LEFT JOIN st USING (symbol, datetime)), {rolling_edges_sql(RB, 'p3', 18)},
   w AS (SELECT m.tm, p3, label, {RB_KEYS} FROM (SELECT DISTINCT ti AS tm FROM j) m JOIN j b ON b.ti < m.tm AND b.ti >= m.tm - 18 LEFT JOIN e_conf ON e_conf.ti = m.tm LEFT JOIN e_range ON e_range.ti = m.tm),
   per AS (SELECT tm AS ti, ck, rk, sk, count(*)::DOUBLE AS n, sum(p3) AS sx, sum(label) AS sy, sum(p3 * p3) AS sxx, sum(p3 * label) AS sxy FROM w GROUP BY ALL), tot AS (SELECT ti, {RB_SUMS} FROM per GROUP BY ti),
   gl AS (SELECT ti, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS gs, (sxx - sx * sx / n) / n AS gv, sy / n AS my, sx / n AS mx FROM tot WHERE n >= 1000), glo AS (SELECT *, my - gs * mx AS gi FROM gl),
   par0 AS (SELECT ti, ck, rk, sk, gs, gi, n, sx, sy, least(greatest((sxy - sx * sy / n + 400 * gv * gs) / (sxx - sx * sx / n + 400 * gv), 0.5), 1.5) AS slope FROM per JOIN glo USING (ti)),
   par AS (SELECT ti, ck, rk, sk, slope, (n * (sy / n - slope * sx / n) + 300 * gi) / (n + 300) AS icpt FROM par0),
   k AS (SELECT symbol, datetime, ti, p3, {RB_KEYS} FROM j LEFT JOIN e_conf USING (ti) LEFT JOIN e_range USING (ti))"""


@query("ca05_rolling_bucket_affine", f"WITH {PREDS}, {RB_SQL} SELECT {KEY}, {r('CASE WHEN gs IS NULL THEN p3 ELSE coalesce(slope, gs) * p3 + coalesce(icpt, gi) END', 'pred_cal')} FROM k LEFT JOIN glo USING (ti) LEFT JOIN par USING (ti, ck, rk, sk)")
def _(t: Tables):
    d = rel.attach_state(t.preds, t.d, ROWS).withColumn("month_no", cal.month_number("month"))
    return out(cal.rolling_bucket_affine(d, ["conf4", "range3", "sign"], "p3", min_train=1000, output="label"), ("pred_cal",))


@query("ca06_group_time_affine", f"""WITH {PREDS}, s AS (SELECT grp, count(*) AS n, avg(p3) AS mx, avg(label) AS my, covar_pop(p3, label) / var_pop(p3) AS own FROM preds WHERE {TRAIN} GROUP BY grp),
   g AS (SELECT covar_pop(p3, label) / var_pop(p3) AS gs FROM preds WHERE {TRAIN}), p AS (SELECT grp, n, n / (n + 2000.0) AS a, own, my - own * mx AS ic0 FROM s WHERE n >= 500),
   q AS (SELECT grp, (1 - a) * gs + a * least(greatest(own, 0.35), 1.85) AS slope, a * 0.35 * ic0 AS icpt FROM p, g)
   SELECT {KEY}, {r('coalesce(slope, gs) * p3 + coalesce(icpt, 0)', 'pred_cal')} FROM preds LEFT JOIN q USING (grp), g""")
def _(t: Tables):
    return out(cal.group_time_affine(t.preds, train_rows(), "grp", "p3", k=2000.0, min_rows=500), ("pred_cal",))


def scales_sql(x: str, steps: int = 400) -> str:
    """The fixed point of the two numbers, by plain steps."""
    up, curve = "(gain * b.a + 0.02 * b.n / o.n)", "(price * b.b + 0.02 * b.n / o.n)"
    s = f"CASE WHEN {curve} > 0 THEN least(greatest({up} / {curve}, 0.7), 1.3) WHEN {up} > {curve} THEN 1.3 ELSE 0.7 END"
    return f"""WITH RECURSIVE {PREDS}, b AS MATERIALIZED (SELECT symbol, sum({x} * label) AS a, sum({x} * {x}) AS b, count(*)::DOUBLE AS n, sum(label * label) AS yy FROM preds WHERE {TRAIN} GROUP BY symbol),
   o AS MATERIALIZED (SELECT sum(a) AS a, sum(b) AS b, sum(n) AS n, sum(yy) AS yy FROM b),
   it AS (SELECT 0 AS k, 1 / sqrt(b * yy) AS gain, a / (sqrt(b * yy) * b) AS price FROM o
          UNION ALL SELECT k + 1, 1 / sqrt(q * yy), num / (sqrt(q * yy) * q) FROM (
            SELECT any_value(k) AS k, sum(s * a) AS num, sum(s * s * b) AS q, any_value(yy) AS yy FROM (SELECT k, b.a, b.b, o.yy, {s} AS s FROM it, b, o WHERE k < {steps})) WHERE k IS NOT NULL),
   z AS (SELECT symbol, {s} AS s FROM it, b, o WHERE k = {steps})
   SELECT {KEY}, {r('label')}, {r(f'{x} * coalesce(s, 1.0)', 'pred_out')} FROM preds LEFT JOIN z USING (symbol)"""


@query("ca07_bucket_scales")  # the blend goes against the label: many local optima
def _(t: Tables):
    return preds_out(cal.bucket_scales(t.preds, train_rows(), "symbol", "p3"), "pred_cal")


@query("ca07_bucket_scales_reversal", scales_sql("(-p3)"))
def _(t: Tables):
    return preds_out(cal.bucket_scales(t.preds.withColumn("rev", -F.col("p3")), train_rows(), "symbol", "rev"), "pred_cal")


SHIFT = f"""s AS (SELECT count(*)::DOUBLE AS n, sum(p2) AS sp, sum(label) AS sy, sum(p2 * p2) AS pp, sum(p2 * label) AS py, sum(label * label) AS yy FROM preds WHERE {TRAIN}),
   g AS (SELECT s.*, k AS step, -3.0::DOUBLE + 6.0::DOUBLE / 48 * k AS coef, (-3.0::DOUBLE + 6.0::DOUBLE / 48 * k) * abs(sp / n) AS sh FROM s, range(49) t(k)),
   v AS (SELECT step, coef, sh, (py - sh * sy) / sqrt((pp - 2 * sh * sp + n * sh * sh) * yy) AS ic FROM g)"""


@query("ca08_shift_grid", f"WITH {PREDS}, {SHIFT} SELECT step::BIGINT AS step, {r('coef')}, {r('sh', 'shift')}, {r('ic', 'ic', 6)} FROM v")
def _(t: Tables):
    g = cal.shift_grid(t.preds, train_rows(), "p2")
    return out(g, ("coef", "shift"), ("step",)).join(out(g, ("ic",), ("step",), 6), "step")


@query("ca08_shifted", f"""WITH {PREDS}, {SHIFT}, b AS (SELECT sh FROM v ORDER BY ic DESC, step LIMIT 1), q AS (SELECT quantile_cont(p2, 0.5) AS md, avg(p2) AS mn FROM preds WHERE {TRAIN})
   SELECT {KEY}, {r('p2 - sh', 'by_grid')}, {r('p2 - md', 'by_median')}, {r('p2 - 0.5 * mn', 'by_mean')} FROM preds, b, q""")
def _(t: Tables):
    d = cal.shifted(t.preds, train_rows(), "p2", "ic_grid", out="by_grid")
    d = cal.shifted(cal.shifted(d, train_rows(), "p2", "median", out="by_median"), train_rows(), "p2", "mean", shrink=0.5, out="by_mean")
    return out(d, ("by_grid", "by_median", "by_mean"))


FOLD = "substr(month, 1, 4)"


def _scores(col: str, x: str) -> str:
    return f"SELECT {col} AS fold, '{x}' AS candidate, sum({x} * label) / sqrt(sum({x} * {x}) * sum(label * label)) AS ic FROM preds GROUP BY 1"


CAND = "c AS (" + " UNION ALL ".join(_scores(FOLD, x) for x in P) + ")"
SEL = """sel AS (SELECT candidate, avg(ic) AS mean_ic, min(ic) AS min_ic, stddev_samp(ic) AS std_ic, avg(ic) - 0.5 * stddev_samp(ic) AS mean_std, 0.5 * min(ic) + 0.5 * avg(ic) AS min_mean, sum(k * ic) / sum(k) AS recent
   FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY fold) AS k FROM c) GROUP BY candidate)"""


def _folds(t: Tables):
    return cal.month_scores(t.preds.withColumn("fold", F.substring("month", 1, 4)), P, month="fold")


@query("ca09_selectors", f"WITH {PREDS}, {CAND}, {SEL} SELECT candidate, {rs(('mean_ic', 'min_ic', 'std_ic', 'mean_std', 'min_mean', 'recent'), 5)} FROM sel")
def _(t: Tables):
    return out(cal.selectors(_folds(t)), ("mean_ic", "min_ic", "std_ic", "mean_std", "min_mean", "recent"), ("candidate",), 5)


@query("ca09_winners", f"""WITH {PREDS}, {CAND}, {SEL}, l AS (SELECT candidate, 'mean_ic' AS selector, mean_ic AS score FROM sel UNION ALL SELECT candidate, 'mean_std', mean_std FROM sel UNION ALL SELECT candidate, 'recent', recent FROM sel)
   SELECT selector, candidate, {r('score', 'score', 5)} FROM l QUALIFY row_number() OVER (PARTITION BY selector ORDER BY score DESC, candidate) = 1""")
def _(t: Tables):
    return out(cal.winners(cal.selectors(_folds(t)), ("mean_ic", "mean_std", "recent")), ("candidate", "score"), ("selector",), 5)


@query("ca10_month_scores", f"WITH {PREDS} " + " UNION ALL ".join(f"SELECT month, '{x}' AS candidate, {r(f'sum({x} * label)', 'xy')}, {r(f'sum({x} * {x})', 'xx')}, {r('sum(label * label)', 'yy')}, {r(f'sum({x} * label) / sqrt(sum({x} * {x}) * sum(label * label))', 'ic')} FROM preds GROUP BY month" for x in P))
def _(t: Tables):
    return out(cal.month_scores(t.preds, P), ("xy", "xx", "yy", "ic"), ("month", "candidate"))


AUX = f"m AS (SELECT greatest(abs(avg(p1)), 1e-8) AS m1, greatest(abs(avg(p2)), 1e-8) AS m2 FROM preds WHERE {TRAIN}), a AS (SELECT preds.*, sqrt(least(greatest((greatest(p1, 0) / m1 + greatest(p2, 0) / m2) / 2, 0.25), 4)) AS s FROM preds, m)"


@query("ca11_aux_scale", f"WITH {PREDS}, {AUX} SELECT {KEY}, {r('p3 * s', 'by_row')}, {r('p3 * avg(s) OVER (PARTITION BY datetime)', 'by_time')} FROM a")
def _(t: Tables):
    d = cal.aux_scale(t.preds, "p3", ("p1", "p2"), train_rows(), power=0.5, out="by_row")
    return out(cal.aux_scale(d, "p3", ("p1", "p2"), train_rows(), power=0.5, g=t.g, out="by_time"), ("by_row", "by_time"))


# ---- blends -------------------------------------------------------------------------------------------
@query("en01_signals", f"WITH {PREDS} SELECT {KEY}, {r('p1', 's_raw')}, {r(pct_rank('p1', 'datetime') + ' - 0.5', 's_rank')}, {r(z_sql('p1', 'datetime', '1e-9'), 's_z')} FROM preds")
def _(t: Tables):
    d = t.preds
    for mode in ("raw", "rank", "z"):
        d = blend.component_signal(d, t.g, "p1", mode, f"s_{mode}")
    return out(d, ("s_raw", "s_rank", "s_z"))


TRI = [(a, b) for k, a in enumerate(P) for b in P[k:]]
STAT = f"count(*) AS n, {', '.join(f'sum({x} * label) AS c_{x}' for x in P)}, {', '.join(f'sum({a} * {b}) AS g_{a}_{b}' for a, b in TRI)}, sum(label * label) AS yy"
STAT_OUT = [f"c_{x}" for x in P] + [f"g_{a}_{b}" for a, b in TRI] + ["yy"]


def flat_stats(s):
    return s.select(*[c for c in s.columns if c in ("month",)], "n", *[c_("c")[k].alias(f"c_{x}") for k, x in enumerate(P)],
                    *[c_("g")[k].alias(f"g_{a}_{b}") for k, (a, b) in enumerate(TRI)], "yy")


@query("en02_month_statistics", f"WITH {PREDS}, s AS (SELECT month, {STAT} FROM preds GROUP BY month) SELECT month, n, {rs(STAT_OUT)} FROM s")
def _(t: Tables):
    return out(flat_stats(blend.month_stats(t.preds, P)), ["n", *STAT_OUT], ("month",))


def grid_sql(step: int, cap: float = 1.0, where: str = "TRUE", keys: str = "", total_to_one: bool = True) -> str:
    w = ["a", "b", f"({step} - a - b)" if total_to_one else "c"]
    q = " + ".join(f"w{x + 1} * w{y + 1} * g_{P[min(x, y)]}_{P[max(x, y)]}" for x in range(3) for y in range(3))
    more = "" if total_to_one else f", range({step + 1}) t3(c)"
    cond = f"a + b <= {step}" if total_to_one else f"a + b + c <= {step}"
    return (f"w AS (SELECT a / {float(step)} AS w1, b / {float(step)} AS w2, {w[2]} / {float(step)} AS w3 FROM range({step + 1}) t1(a), range({step + 1}) t2(b){more} WHERE {cond}), "
            f"grid AS (SELECT s.*, w1, w2, w3, (w1 * c_p1 + w2 * c_p2 + w3 * c_p3) / sqrt({q}) / sqrt(yy) AS ic FROM s, w WHERE greatest(w1, w2, w3) <= {cap} + 1e-9 AND ({q}) * yy > 1e-24)")


@query("en03_weight_grid", f"WITH {PREDS}, s AS (SELECT {STAT} FROM preds WHERE {TRAIN}), {grid_sql(10)} SELECT {r('w1')}, {r('w2')}, {r('w3')}, {r('ic', 'ic', 6)} FROM grid")
def _(t: Tables):
    g = blend.weight_grid(gram(t.preds.where(train_rows()), [], P, "label"), 3, 0.1)
    return out(g.select(*[c_("weights")[k].alias(f"w{k + 1}") for k in range(3)], "ic"), ("w1", "w2", "w3", "ic"), (), 6)


@query("en03_grid_blend", f"WITH {PREDS}, s AS (SELECT {STAT} FROM preds WHERE {TRAIN}), {grid_sql(10)}, b AS (SELECT * FROM grid ORDER BY ic DESC, w1, w2, w3 LIMIT 1) SELECT {KEY}, {r('w1 * p1 + w2 * p2 + w3 * p3', 'pred')} FROM preds, b")
def _(t: Tables):
    g = blend.best_grid_weight(blend.weight_grid(gram(t.preds.where(train_rows()), [], P, "label"), 3, 0.1))
    return out(blend.apply_weights(t.preds, g, [], P), ("pred",))


@query("en04_bounded_ic_fit")
def _(t: Tables):
    w, _ = linear.ic_weights(-0.5, 0.9)(row_stats(t, train_rows()))
    return preds_out(t.preds.withColumn("pred", score(P, w)))


def simplex3_sql(src: str) -> str:
    """SQL for the non-negative weights of sum one with the best IC: the seven supports of three components, each solved by Cramer's rule."""
    one = [f"SELECT {', '.join(f'{float(i == j)} AS w{j}' for j in (1, 2, 3))} FROM {src}" for i in (1, 2, 3)]
    two = []
    for i, j in ((1, 2), (1, 3), (2, 3)):
        w = {i: f"(c{i} * g{j}{j} - c{j} * g{i}{j}) / (g{i}{i} * g{j}{j} - g{i}{j} * g{i}{j})", j: f"(c{j} * g{i}{i} - c{i} * g{i}{j}) / (g{i}{i} * g{j}{j} - g{i}{j} * g{i}{j})"}
        two.append(f"SELECT {', '.join(f'{w.get(k, 0.0)} AS w{k}' for k in (1, 2, 3))} FROM {src}")
    three = f"SELECT w1, w2, w3 FROM ({ridge3_sql(src, 0.0, intercept=False)})"
    quad = " + ".join(f"{1 if i == j else 2} * w{i} * w{j} * g{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    return (f"SELECT w1 / (w1 + w2 + w3) AS w1, w2 / (w1 + w2 + w3) AS w2, w3 / (w1 + w2 + w3) AS w3 FROM ({' UNION ALL '.join([*one, *two, three])}) q, {src} "
            f"WHERE least(w1, w2, w3) >= 0 AND w1 + w2 + w3 > 0 ORDER BY (w1 * c1 + w2 * c2 + w3 * c3) / sqrt({quad}) DESC LIMIT 1")


@query("en05_simplex_fit", f"""WITH {PREDS}, st AS ({sums3('preds', where='WHERE ' + TRAIN)}), b AS ({simplex3_sql('st')})
   SELECT {KEY}, {r('label')}, {r('w1 * p1 + w2 * p2 + w3 * p3', 'pred_out')} FROM preds, b""")
def _(t: Tables):
    w, _ = linear.simplex()(row_stats(t, train_rows()))
    return preds_out(t.preds.withColumn("pred", score(P, w)))


ICS = {x: f"c_{x} / sqrt(g_{x}_{x} * yy)" for x in P}


@query("en06_closed_rules", f"""WITH {PREDS}, s AS (SELECT month, {STAT} FROM preds GROUP BY month), k AS (SELECT *, {', '.join(f'{e} AS i_{x}' for x, e in ICS.items())} FROM s),
   z AS (SELECT *, greatest(i_p1, 0) + greatest(i_p2, 0) + greatest(i_p3, 0) AS tot FROM k)
   SELECT month, {', '.join(r(f'(i_{x} = greatest(i_p1, i_p2, i_p3))::INT', f'top_{x}') for x in P)}, {', '.join(r(f'CASE WHEN tot > 0 THEN greatest(i_{x}, 0) / tot ELSE 1 / 3.0 END', f'icw_{x}') for x in P)}, {', '.join(r('1 / 3.0', f'eq_{x}') for x in P)} FROM z""")
def _(t: Tables):
    s = blend.month_stats(t.preds, P)
    d = None
    for rule, n in (("top1", "top"), ("ic", "icw"), ("equal", "eq")):
        w = blend.closed_weights(s, 3, rule).select("month", *[c_("weights")[k].alias(f"{n}_{x}") for k, x in enumerate(P)])
        d = w if d is None else d.join(w, "month")
    return out(d, [f"{n}_{x}" for n in ("top", "icw", "eq") for x in P], ("month",))


@query("en07_capped_grid", f"WITH {PREDS}, s AS (SELECT {STAT} FROM preds WHERE {TRAIN}), {grid_sql(20, 0.6)} SELECT {r('w1')}, {r('w2')}, {r('w3')}, {r('ic', 'ic', 6)} FROM grid")
def _(t: Tables):
    g = blend.weight_grid(gram(t.preds.where(train_rows()), [], P, "label"), 3, 0.05, cap=0.6)
    return out(g.select(*[c_("weights")[k].alias(f"w{k + 1}") for k in range(3)], "ic"), ("w1", "w2", "w3", "ic"), (), 6)


@query("en08_fit_apply")
def _(t: Tables):
    return preds_out(blend.fit_apply(t.preds, train_rows(), P, linear.simplex(), time_minutes=90))


@query("en09_rolling_blend")
def _(t: Tables):
    return preds_out(blend.rolling_blend(t.preds, P, min_months=12, anchor="p1", anchor_min=0.1)[0])


@query("en09_remembered", f"""WITH {PREDS}, z AS (SELECT *, -p1 AS p, CASE WHEN month LIKE '%-07' THEN 0.0 ELSE -p3 END AS q FROM preds),
   ms AS (SELECT month, row_number() OVER (ORDER BY month) AS k, sum(p * label) AS c1, sum(q * label) AS c2, sum(p * p) AS g1, sum(p * q) AS g12, sum(q * q) AS g2, stddev_pop(p) AS s1, stddev_pop(q) AS s2 FROM z GROUP BY month),
   s AS (SELECT a.month, a.k - 1 AS times, any_value(a.s1) > 1e-10 AND max(b.s1) > 1e-10 AS on1, any_value(a.s2) > 1e-10 AND max(b.s2) > 1e-10 AS on2, {', '.join(f'sum(b.{x}) AS {x}' for x in ('c1', 'c2', 'g1', 'g12', 'g2'))}
         FROM ms a LEFT JOIN ms b ON b.k < a.k GROUP BY a.month, a.k),
   c AS (SELECT *, unnest([0.1, 0.9, least(greatest((c1 * g2 - c2 * g12) / (c1 * g2 - c2 * g12 + c2 * g1 - c1 * g12), 0.1), 0.9)]) AS a FROM s),
   b AS (SELECT *, (a * c1 + (1 - a) * c2) / sqrt(a * a * g1 + 2 * a * (1 - a) * g12 + (1 - a) * (1 - a) * g2) AS v FROM c),
   f AS (SELECT month, CASE WHEN times < 12 THEN 0.5 WHEN on1 AND NOT on2 THEN 1.0 WHEN on2 AND NOT on1 THEN 0.0 ELSE a END AS a FROM b QUALIFY row_number() OVER (PARTITION BY month ORDER BY v DESC NULLS LAST) = 1)
   SELECT {KEY}, {r('a', 'weight', 3)}, {r('a * p + (1 - a) * q', 'pred', 3)} FROM z JOIN f USING (month)""")
def _(t: Tables):
    d = t.preds.withColumn("q", F.when(~F.col("month").endswith("-07"), -F.col("p3"))).withColumn("p", -F.col("p1"))  # q is missing in July
    d, table = blend.remembered_blend(d, ["p", "q"], min_months=12, anchor="p", anchor_min=0.1)
    return out(d.join(table.select("month", F.element_at("weights", 1).alias("weight")), "month"), ("weight", "pred"), digits=3)


@query("en09_rolling_grid", f"""WITH {PREDS}, ms AS (SELECT month, {STAT} FROM preds GROUP BY month), o AS (SELECT *, row_number() OVER (ORDER BY month) AS k FROM ms),
   s AS (SELECT a.month, {', '.join(f'sum(b.{x}) AS {x}' for x in STAT_OUT)} FROM o a JOIN o b ON b.k < a.k AND b.k >= a.k - 12 GROUP BY a.month), {grid_sql(10)}
   SELECT month, {r('w1')}, {r('w2')}, {r('w3')}, {r('ic', 'ic', 6)} FROM grid QUALIFY row_number() OVER (PARTITION BY month ORDER BY ic DESC, w1, w2, w3) = 1""")
def _(t: Tables):
    b = blend.rolling_grid_blend(t.preds, P, lookback=12)
    return out(b.select("month", *[c_("weights")[k].alias(f"w{k + 1}") for k in range(3)], "ic"), ("w1", "w2", "w3", "ic"), ("month",), 6)


@query("en10_static", f"WITH {PREDS} SELECT {KEY}, {r('0.2 * p1 + 0.3 * p2 + 0.5 * p3', 'pred')} FROM preds")
def _(t: Tables):
    return out(t.preds.withColumn("pred", score(P, (0.2, 0.3, 0.5))), ("pred",))


MOM = "count(*)::DOUBLE AS n, sum(p1 * p1) AS pp, sum(p1 * p3) AS pq, sum(p3 * p3) AS qq, sum(p1 * label) AS py, sum(p3 * label) AS qy, sum(label * label) AS yy"


def alpha_sql(src: str, keys: str, steps: int) -> str:
    return (f"ag AS (SELECT {src}.*, k / {float(steps - 1)} AS alpha, k FROM {src}, range({steps}) tt(k)), "
            f"ai AS (SELECT *, ((1 - alpha) * py + alpha * qy) / sqrt(greatest(((1 - alpha) ^ 2 * pp + 2 * alpha * (1 - alpha) * pq + alpha ^ 2 * qq) * yy, 1e-30)) AS ic FROM ag), "
            f"best AS (SELECT * FROM ai QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(ic, 12) DESC, k) = 1)")


def _roll(by: str) -> str:
    g = ", grp" if by else ""
    return (f"ym AS (SELECT *, {YM} AS ti FROM preds), cl AS (SELECT ti{g}, {MOM} FROM ym GROUP BY ti{g}), "
            f"pa AS (SELECT m.ti{', c.grp' if by else ''}, {', '.join(f'sum(c.{x}) AS {x}' for x in ('n', 'pp', 'pq', 'qq', 'py', 'qy', 'yy'))} FROM (SELECT DISTINCT ti FROM ym) m JOIN cl c ON c.ti < m.ti AND c.ti >= m.ti - 12 GROUP BY ALL HAVING sum(c.n) >= 300), "
            + alpha_sql("pa", f"ti{g}", 21))


@query("en11_rolling_alpha", f"WITH {PREDS}, {_roll('')} SELECT {KEY}, {r('coalesce(alpha, 0)', 'alpha')}, {r('(1 - coalesce(alpha, 0)) * p1 + coalesce(alpha, 0) * p3', 'pred')} FROM ym LEFT JOIN (SELECT ti, alpha FROM best) USING (ti)")
def _(t: Tables):
    return out(blend.rolling_alpha(t.preds, "p1", "p3", min_rows=300)[0], ("alpha", "pred"))


@query("en11_rolling_group_alpha", f"WITH {PREDS}, {_roll('grp')} SELECT {KEY}, {r('coalesce(alpha, 0)', 'alpha')}, {r('(1 - coalesce(alpha, 0)) * p1 + coalesce(alpha, 0) * p3', 'pred')} FROM ym LEFT JOIN (SELECT ti, grp, alpha FROM best) USING (ti, grp)")
def _(t: Tables):
    return out(blend.rolling_alpha(t.preds, "p1", "p3", by=["grp"], min_rows=300)[0], ("alpha", "pred"))


@query("en12_group_gate")
def _(t: Tables):
    return preds_out(blend.group_gate(t.preds, train_rows(), P, "grp", min_rows=1000))


@query("en13_daily_mixture")
def _(t: Tables):
    return preds_out(blend.daily_mixture(t.preds, P))


@query("en14_weighting_schemes", f"""WITH {PREDS}, ms AS (SELECT month, {STAT} FROM preds GROUP BY month), a AS (SELECT *, (SELECT max({YM}) FROM ms) - {YM} AS age FROM ms),
   f AS (SELECT 'row' AS scheme, 1.0::DOUBLE AS f, * FROM a UNION ALL SELECT 'month_equal', 1.0::DOUBLE / n, * FROM a UNION ALL SELECT 'month_decay', 0.5::DOUBLE ^ (age / 6.0::DOUBLE) / n, * FROM a)
   SELECT scheme, {', '.join(r(f'sum(f * {x})', x) for x in STAT_OUT)} FROM f GROUP BY scheme""")
def _(t: Tables):
    s, d = blend.month_stats(t.preds, P), None
    for scheme in ("row", "month_equal", "month_decay"):
        one = flat_stats(blend.weighted_stats(s, scheme, 3)).withColumn("scheme", F.lit(scheme))
        d = one if d is None else d.unionByName(one)
    return out(d, STAT_OUT, ("scheme",))


@query("en15_embargoed_gate")
def _(t: Tables):
    d = t.preds.join(t.d.select("symbol", "datetime", "bar_no"), ["symbol", "datetime"])
    return preds_out(blend.embargoed_gate(d, train_rows(), P, 20))


@query("en16_gate_grid")
def _(t: Tables):
    folds = [Stats.of(s) for s in gram(t.preds.withColumn("y", F.year("datetime")), ["y"], P, "label").orderBy("y").collect()]  # one row a year
    rows = blend.gate_grid(folds, P, {"all": (0, 1, 2), "two": (0, 2)}, ((0.0, 0.8), (-0.2, 1.0)), (0.0, 0.1))
    return _names(t, rows, "subset string, lo double, hi double, ridge double, mean_ic double, min_ic double")


@query("en17_bucketed_mixture")
def _(t: Tables):
    d = t.preds.withColumn("eventful", (F.abs("p1") > 1).cast("long")).withColumn("tb", cal.time_key(240))
    return preds_out(blend.bucketed_mixture(d, train_rows(), P, ["grp", "tb", "eventful"]))


@query("en18_static_alpha", f"WITH {PREDS}, m AS (SELECT 1 AS one, {MOM} FROM preds WHERE {TRAIN}), {alpha_sql('m', 'one', 41)} SELECT {KEY}, {r('alpha')}, {r('(1 - alpha) * p1 + alpha * p3', 'pred')} FROM preds, best")
def _(t: Tables):
    return out(blend.static_alpha(t.preds, train_rows(), "p1", "p3"), ("alpha", "pred"))


def with_views(t: Tables):
    d = views.csz(t.preds, t.g, P, 1e-9, "xsz_")
    return d.withColumns({f"xsz_{x}": F.coalesce(f"xsz_{x}", F.lit(0.0)) for x in P})


@query("en19_view_stack")
def _(t: Tables):
    return preds_out(blend.view_stack(with_views(t), train_rows(), [*P, *[f"xsz_{x}" for x in P]], "p"))


@query("en20_rolling_stack")
def _(t: Tables):
    d = labels.label_views(with_views(t).drop("label_xsz"), t.g)
    return preds_out(blend.rolling_stack(d, [f"xsz_{x}" for x in P], "label_xrank", min_rows=500))


@query("en21_market_overlay")
def _(t: Tables):
    return preds_out(blend.market_overlay(t.preds, t.g, train_rows(), P, "p3", (0.1, 1.0), (0.0, 0.25, 0.5))[0])


GZ = {x: f"least(greatest(({x} - (SELECT avg({x}) FROM preds WHERE {TRAIN})) / ((SELECT stddev_pop({x}) FROM preds WHERE {TRAIN}) + 1e-6), -8), 8)" for x in P}


@query("en22_gate_features", f"""WITH {PREDS}, z AS (SELECT symbol, datetime, [{', '.join(GZ.values())}] AS z FROM preds) SELECT {KEY}, {r('list_avg(z)', 'gate_mean')}, {r('list_stddev_pop(z)', 'gate_std')},
   {r('list_avg(list_transform(z, lambda v: abs(v)))', 'gate_abs')}, {r('list_max(z)', 'gate_max')}, {r('list_min(z)', 'gate_min')} FROM z""")
def _(t: Tables):
    return out(blend.gate_features(t.preds, train_rows(), P), ("gate_mean", "gate_std", "gate_abs", "gate_max", "gate_min"))


# ---- memory -------------------------------------------------------------------------------------------
def _mem_sql() -> str:
    e = lambda x: f"(SELECT list_distinct(quantile_cont({x}, [0.25, 0.5, 0.75])) AS e FROM preds WHERE {TRAIN})"
    keys = [("symbol", "tb", "b1", "b3"), ("symbol", "b1", "b3"), ("tb", "b1", "b3"), ("b1", "b3"), ("symbol", "tb"), ("symbol",), ("tb",)]
    tabs = ", ".join(f"m{k} AS (SELECT {', '.join(s)}, (sum(w * label) + 100 * (SELECT gm FROM gl)) / (sum(w) + 100) AS v{k} FROM tr GROUP BY {', '.join(s)} HAVING count(*) >= 30)" for k, s in enumerate(keys))
    joins = " ".join(f"LEFT JOIN m{k} USING ({', '.join(s)})" for k, s in enumerate(keys))
    return (f"e1 AS {e('p1')}, e3 AS {e('p3')}, kd AS (SELECT preds.*, (hour(datetime) * 60 + minute(datetime)) // 60 AS tb, len(list_filter(e1.e, lambda v: v <= p1)) AS b1, len(list_filter(e3.e, lambda v: v <= p3)) AS b3 FROM preds, e1, e3), "
            f"tr AS (SELECT *, greatest(0.5::DOUBLE ^ (date_diff('second', datetime, max(datetime) OVER ()) / 86400.0 / 400), 1e-6) AS w FROM kd WHERE {TRAIN}), gl AS (SELECT sum(w * label) / sum(w) AS gm FROM tr), {tabs}, "
            f"mem AS (SELECT kd.*, coalesce({', '.join(f'v{k}' for k in range(7))}, (SELECT gm FROM gl)) AS memory FROM kd {joins})")


def remembered(t: Tables):
    return memory.regime_memory(t.preds, train_rows(), ("p1", "p3"), (0.25, 0.5, 0.75), 60, 30, 100.0, 400.0)


@query("en23_regime_memory", f"WITH {PREDS}, {_mem_sql()} SELECT {KEY}, {r('memory')} FROM mem")
def _(t: Tables):
    return out(remembered(t), ("memory",))


MM = "count(*)::DOUBLE AS n, sum(p3 * p3) AS pp, sum(p3 * memory) AS pq, sum(memory * memory) AS qq, sum(p3 * label) AS py, sum(memory * label) AS qy, sum(label * label) AS yy"


@query("en24_memory_blend", f"WITH {PREDS}, {_mem_sql()}, mm AS (SELECT 1 AS one, {MM} FROM mem WHERE NOT ({TRAIN})), {alpha_sql('mm', 'one', 21)} SELECT {r('alpha')}, {r('ic', 'ic', 6)} FROM best")
def _(t: Tables):
    g = blend.alpha_grid(blend.pair_moments(remembered(t).where(~train_rows()), [], "p3", "memory"), 21)
    return out(blend.best_alpha(g, []), ("alpha", "ic"), (), 6)


RW = (0.0, 0.5, 1.0, 2.0)


@query("en24_residual_weight", f"WITH {PREDS}, {_mem_sql()}, mm AS (SELECT {MM} FROM mem WHERE NOT ({TRAIN})), g AS (SELECT w, (py + w * qy) / sqrt((pp + 2 * w * pq + w * w * qq) * yy) AS ic FROM mm, (VALUES "
       + ", ".join(f"({w}::DOUBLE)" for w in RW) + f") v(w)) SELECT {r('w', 'weight')}, {r('ic', 'ic', 6)} FROM g")
def _(t: Tables):
    m = blend.pair_moments(remembered(t).where(~train_rows()), [], "p3", "memory")
    return out(blend.residual_grid(m, RW), ("weight", "ic"), (), 6)


@query("en24_multi_memory_grid", f"WITH {PREDS}, s AS (SELECT {STAT} FROM preds WHERE NOT ({TRAIN})), {grid_sql(5, 0.6, total_to_one=False)} SELECT {r('w1')}, {r('w2')}, {r('w3')}, {r('ic', 'ic', 6)} FROM grid")
def _(t: Tables):
    g = blend.weight_grid(gram(t.preds.where(~train_rows()), [], P, "label"), 3, 0.2, cap=0.6, total_max=1.0).where("ic is not null")
    return out(g.select(*[c_("weights")[k].alias(f"w{k + 1}") for k in range(3)], "ic"), ("w1", "w2", "w3", "ic"), (), 6)


# ---- branches, guards, rules ----------------------------------------------------------------------------
BRANCH_GRID = (-0.5, -0.25, -0.1, 0.1, 0.25, 0.5)
_xy, _xx = (f"({e})" for e in ("w1 * y1 + w2 * y2 + w3 * y3", "w1 * w1 * g11 + w2 * w2 * g22 + w3 * w3 * g33 + 2 * (w1 * w2 * g12 + w1 * w3 * g13 + w2 * w3 * g23)"))
_new = lambda e: e.replace("w1", "n1").replace("w2", "n2").replace("w3", "n3")


def branches_sql(start: int, positive: int, decline: float, last: float) -> str:
    return f"""WITH RECURSIVE {PREDS}, gs AS (SELECT month, sum(label * label) AS yy, {', '.join(f'sum(p{k} * label) AS y{k}' for k in (1, 2, 3))},
     {', '.join(f'sum(p{j} * p{k}) AS g{j}{k}' for j in (1, 2, 3) for k in (1, 2, 3) if j <= k)} FROM preds WHERE NOT ({TRAIN}) GROUP BY month),
   ws AS (SELECT {', '.join(f'{float(k == start)}::DOUBLE AS w{k}' for k in (1, 2, 3))}),
   walk AS (SELECT 0::BIGINT AS step, [{start}]::INT[] AS used, ws.*, (SELECT sum({_xy}) / sqrt(sum({_xx}) * sum(yy)) FROM gs, ws) AS ic,
       NULL::STRUCT(ic DOUBLE, c INT, a DOUBLE, n1 DOUBLE, n2 DOUBLE, n3 DOUBLE, pos BIGINT, low DOUBLE, late DOUBLE) AS best FROM ws
     UNION ALL SELECT step + 1, list_append(used, best.c), best.n1, best.n2, best.n3, best.ic, best FROM (
       SELECT step, used, max({{'ic': ic_new, 'c': c, 'a': a, 'n1': n1, 'n2': n2, 'n3': n3, 'pos': pos, 'low': low, 'late': late}}) AS best FROM (
         SELECT step, used, ic, c, a, n1, n2, n3, sum({_new(_xy)}) / sqrt(sum({_new(_xx)}) * sum(yy)) AS ic_new, count(*) FILTER (gain > 0) AS pos, count(*) AS n, min(gain) AS low, max_by(gain, month) AS late
         FROM (SELECT *, {_new(_xy)} / sqrt({_new(_xx)} * yy) - {_xy} / sqrt({_xx} * yy) AS gain FROM (
           SELECT v.step, v.used, v.ic, v.w1, v.w2, v.w3, c, a, {', '.join(f'(1 - a) * w{k} + a * (c = {k})::INT AS n{k}' for k in (1, 2, 3))}
           FROM walk v, (VALUES (1), (2), (3)) q(c), (VALUES {', '.join(f'({x}::DOUBLE)' for x in BRANCH_GRID)}) g(a) WHERE NOT list_contains(v.used, c) AND v.step < 5) t, gs)
         GROUP BY step, used, ic, c, a, n1, n2, n3)
       WHERE pos >= least({positive}, n) AND low >= {decline} AND late >= {last} AND ic_new >= ic + 1e-4 GROUP BY step, used))
   SELECT step, CASE WHEN step = 0 THEN 'p{start}' ELSE 'p' || best.c END AS candidate, {r('CASE WHEN step = 0 THEN 1 ELSE best.a END', 'weight')}, {r('ic', 'ic', 6)},
     coalesce(best.pos, 0)::BIGINT AS positive_groups, {r('coalesce(best.low, 0)', 'min_group_delta', 6)}, {r('coalesce(best.late, 0)', 'last_group_delta', 6)} FROM walk"""


def _branches(t: Tables, start: int, positive: int, decline: float, last: float):
    rows = gram(t.preds.where(~train_rows()), ["month"], list(P), "label").orderBy("month").collect()  # one row a month
    steps = blend.greedy_branches([Stats.of(x) for x in rows], P, BRANCH_GRID, start=start - 1, min_positive=positive, max_decline=decline, min_last=last)
    d = t.spark.createDataFrame(steps, "step long, candidate string, weight double, ic double, positive_groups long, min_group_delta double, last_group_delta double")
    return out(d, ("weight", "ic", "positive_groups", "min_group_delta", "last_group_delta"), ("step", "candidate"), 6)


@query("en25_greedy_branches", branches_sql(2, 0, -1e9, -1e9))
def _(t: Tables):
    return _branches(t, 2, 0, -1e9, -1e9)


@query("en25_stable_branches", branches_sql(2, 30, 0.01, 0.0))
def _(t: Tables):
    """The same with a gate: enough months gain, none loses much, nor does the last."""
    return _branches(t, 2, 30, 0.01, 0.0)


def _dl(x: str) -> str:
    return f"sum({x} * label) / sqrt(sum({x} * {x}) * sum(label * label))"


@query("en26_stability", f"""WITH {PREDS}, g AS (SELECT month, {_dl('p1')} AS cur, {_dl('(0.7 * p1 + 0.3 * p3)')} AS cand, count(*) AS n FROM preds GROUP BY month), d AS (SELECT month, cand - cur AS delta FROM g WHERE n >= 2)
   SELECT sum((delta > 0)::INT)::BIGINT AS positive_groups, count(*) AS n_groups, {r('min(delta)', 'min_delta', 6)}, {r('arg_max(delta, month)', 'last_delta', 6)}, sum((delta > 0)::INT) >= 40 AND min(delta) >= -0.5 AS passes FROM d""")
def _(t: Tables):
    s = memory.stability(t.preds.withColumn("cand", F.lit(0.7) * c_("p1") + F.lit(0.3) * c_("p3")), "month", "p1", "cand", min_positive=40, max_decline=-0.5)
    return out(s, ("positive_groups", "n_groups", "min_delta", "last_delta", "passes"), (), 6)


@query("en27_symbol_guard", f"WITH {PREDS}, g AS (SELECT symbol FROM preds WHERE {TRAIN} GROUP BY symbol HAVING count(*) >= 100 AND {_dl('p1')} <= -0.27) SELECT {KEY}, {r('CASE WHEN g.symbol IS NULL THEN p1 ELSE 0.4 * p1 END', 'pred')} FROM preds LEFT JOIN g USING (symbol)")
def _(t: Tables):
    return out(memory.symbol_guard(t.preds, train_rows(), "p1", ic_below=-0.27, weight=0.4), ("pred",))


@query("en27_symbol_guard_grid")
def _(t: Tables):
    return preds_out(memory.symbol_guard_grid(t.preds, train_rows(), "p2", (0.0, 0.5, 1.0), ic_below=0.05))


GUARD_W, GUARD_C = (-0.5, -0.25, 0.25, 0.5), ("p1", "p3")
_gs = ", ".join(f"sum({c}) AS s_{c}, sum({c} * label) AS y_{c}, sum({c} * {c}) AS g_{c}, sum(p2 * {c}) AS c_{c}" for c in GUARD_C)
_dev = lambda c: f"greatest(sqrt(greatest(g_{c} / n - (s_{c} / n) ^ 2, 0)), 1e-8)"
_ab = ", ".join(f"{_dev('p2')} / {_dev(c)} AS a_{c}, s_p2 / n - {_dev('p2')} / {_dev(c)} * s_{c} / n AS b_{c}" for c in GUARD_C)
_cc = " UNION ALL ".join(f"SELECT symbol, '{c}' AS candidate, a_{c} * y_{c} + b_{c} * sy AS cy, a_{c} ^ 2 * g_{c} + 2 * a_{c} * b_{c} * s_{c} + b_{c} ^ 2 * n AS cc, "
                         f"a_{c} * c_{c} + b_{c} * s_p2 AS c0 FROM ab" for c in GUARD_C)


@query("en28_candidate_guard", f"""WITH RECURSIVE {PREDS}, mo AS (SELECT symbol, count(*) AS n, sum(label) AS sy, sum(label * label) AS yy, sum(p2) AS s_p2, sum(p2 * label) AS y_p2, sum(p2 * p2) AS g_p2, {_gs}
     FROM preds WHERE {TRAIN} GROUP BY symbol),
   tot AS (SELECT sum(y_p2) AS xy, sum(g_p2) AS xx, sum(yy) AS yy FROM mo),
   el AS (SELECT *, y_p2 / sqrt(g_p2 * yy) AS ic FROM mo WHERE n >= 100 AND symbol IN (SELECT symbol FROM preds WHERE NOT ({TRAIN}))),
   ok AS (SELECT *, row_number() OVER (ORDER BY ic, symbol) AS k FROM el WHERE ic <= 0.05), ab AS (SELECT *, {_ab} FROM ok), cn AS ({_cc}),
   bl AS (SELECT o.k, o.symbol, o.ic, o.yy, o.y_p2, o.g_p2, candidate, w, (1 - w) * y_p2 + w * cy AS ny, (1 - w) ^ 2 * g_p2 + 2 * w * (1 - w) * c0 + w ^ 2 * cc AS nx
     FROM ok o JOIN cn USING (symbol), (VALUES {', '.join(f'({v}::DOUBLE)' for v in sorted((0.0, *GUARD_W)))}) g(w)),
   walk AS (SELECT 0::BIGINT AS k, xy, xx, yy AS ally, ''::VARCHAR AS symbol, 0.0::DOUBLE AS ic, 0.0::DOUBLE AS before, NULL::STRUCT(f DOUBLE, g DOUBLE, c VARCHAR, w DOUBLE, dy DOUBLE, dx DOUBLE) AS best FROM tot
     UNION ALL SELECT k, xy + coalesce(CASE WHEN best.w <> 0 THEN best.dy END, 0), xx + coalesce(CASE WHEN best.w <> 0 THEN best.dx END, 0), ally, symbol, ic, xy / sqrt(xx * ally), best
     FROM (SELECT b.k, v.xy, v.xx, v.ally, b.symbol, b.ic, max({{'f': (v.xy + ny - y_p2) / sqrt((v.xx + nx - g_p2) * v.ally), 'g': ny / sqrt(nx * b.yy), 'c': candidate, 'w': w, 'dy': ny - y_p2, 'dx': nx - g_p2}})
         FILTER (ny / sqrt(nx * b.yy) >= b.ic + 1e-4 AND (v.xy + ny - y_p2) / sqrt((v.xx + nx - g_p2) * v.ally) > v.xy / sqrt(v.xx * v.ally)) AS best
       FROM walk v JOIN bl b ON b.k = v.k + 1 GROUP BY b.k, v.xy, v.xx, v.ally, b.symbol, b.ic))
   SELECT symbol, best.c AS candidate, {r('best.w', 'weight')}, {r('ic', 'symbol_ic', 6)}, {r('best.g', 'symbol_ic_after', 6)}, {r('before', 'ic_before', 6)}, {r('best.f', 'ic_after', 6)}
   FROM walk WHERE best.w <> 0""")
def _(t: Tables):
    chosen = memory.candidate_guard(t.preds, train_rows(), "p2", GUARD_C, GUARD_W, ic_lte=0.05, rescale=True, min_group=1e-4)
    return out(chosen, ("weight", "symbol_ic", "symbol_ic_after", "ic_before", "ic_after"), ("symbol", "candidate"), 6)


@query("en28_guarded_prediction")
def _(t: Tables):
    """The prediction with the candidates the guard chose."""
    chosen = memory.candidate_guard(t.preds, train_rows(), "p2", GUARD_C, GUARD_W, ic_lte=0.05, rescale=True, min_group=1e-4)
    return preds_out(memory.apply_candidate_guard(t.preds, chosen, "p2", GUARD_C))


CSB = f"""cz AS (SELECT *, coalesce((p3 - avg(p3) OVER (PARTITION BY datetime)) / nullif(stddev_samp(p3) OVER (PARTITION BY datetime), 0), 0) AS z FROM preds),
   sc AS (SELECT avg(z) AS mz, stddev_pop(z) AS sz, avg(p3) AS mp, stddev_pop(p3) AS sp FROM cz WHERE {TRAIN}), cs AS (SELECT cz.*, (z - mz) / greatest(sz, 1e-8) * greatest(sp, 1e-8) + mp AS cs FROM cz, sc),
   mo AS (SELECT sum(p3 * p3) AS pp, sum(p3 * cs) AS pq, sum(cs * cs) AS qq, sum(p3 * label) AS py, sum(cs * label) AS qy, sum(label * label) AS yy FROM cs WHERE {TRAIN}),
   wg AS (SELECT w, ((1 - w) * py + w * qy) / sqrt(((1 - w) ^ 2 * pp + 2 * w * (1 - w) * pq + w ^ 2 * qq) * yy) AS ic FROM mo, (VALUES (0.0::DOUBLE), (-0.1::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) v(w)),
   bw AS (SELECT w FROM wg ORDER BY ic DESC, abs(w) LIMIT 1)"""


@query("en29_cross_section_blend", f"WITH {PREDS}, {CSB} SELECT {KEY}, {r('w', 'cs_weight')}, {r('(1 - w) * p3 + w * cs', 'pred')} FROM cs, bw")
def _(t: Tables):
    return out(blend.cross_section_blend(t.preds, t.g, train_rows(), "p3", "zscore", (-0.1, 0.1, 0.3)), ("cs_weight", "pred"))


@query("en30_offset_override", f"WITH {PREDS}, m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS k FROM (SELECT DISTINCT month FROM preds)) SELECT {KEY}, {i('k', 'offset')}, {r('CASE WHEN k % 3 = 1 THEN p3 ELSE p1 END', 'pred')} FROM preds JOIN m USING (month)")
def _(t: Tables):
    return out(memory.override_by_offset(t.preds, "p1", "p3", (1,), 3), ("offset", "pred"))


RULES = ({"name": "weak", "ic_lte": -0.3, "scale": 0.5}, {"name": "light_memory", "mem_lte": 0.6, "ic_lte": -0.2, "scale": 0.8}, {"name": "heavy_memory", "mem_gte": 0.8, "scale": 1.2})


@query("en31_freeze_rules", f"""WITH {PREDS}, q AS (SELECT strftime(datetime, '%Y') || 'Q' || quarter(datetime) AS split, {_dl('p1')} AS ic, avg(p3) + 0.7 AS memory_weight FROM preds GROUP BY 1)
   SELECT split, {r('ic', 'ic', 6)}, CASE WHEN ic <= -0.3 THEN 'weak' WHEN memory_weight <= 0.6 AND ic <= -0.2 THEN 'light_memory' WHEN memory_weight >= 0.8 THEN 'heavy_memory' END AS rule,
   CASE WHEN ic <= -0.3 THEN 0.5::DOUBLE WHEN memory_weight <= 0.6 AND ic <= -0.2 THEN 0.8::DOUBLE WHEN memory_weight >= 0.8 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM q""")
def _(t: Tables):
    m = t.preds.groupBy(F.concat(F.year("datetime"), F.lit("Q"), F.quarter("datetime")).alias("split")).agg(ev.ic("p1", "label").alias("ic"), (F.avg("p3") + 0.7).alias("memory_weight"))
    return out(memory.first_rule(m, RULES), ("ic", "rule", "scale"), ("split",), 6)


@query("en32_outer_harness")
def _(t: Tables):
    rows = blend.outer_harness(with_views(t), {"raw3": P, "xsz3": [f"xsz_{x}" for x in P]}, {"equal": linear.equal(), "simplex": linear.simplex(), "ridge": linear.ridge(0.1, per_row=True)},
                               (("1998-01", "1998-07"), ("1998-07", "1999-01"), ("1999-01", "1999-07")), "1999-07")
    return _names(t, [(a, b, float(v)) for a, b, v in rows], "candidate string, fold string, ic double")


_rows = lambda values: ", ".join(f"('{v}')" for v in values)


@query("en33_candidate_catalog", f"""WITH {PREDS}, sc AS ({' UNION ALL '.join(f"SELECT '{x}' AS factor, sum({x} * label) / sqrt(sum({x} * {x}) * sum(label * label)) AS ic FROM preds WHERE {TRAIN}" for x in P)}),
   o AS (SELECT list(factor ORDER BY abs(ic) DESC, factor) AS c FROM sc),
   sets AS (SELECT s.name AS feature_set, flatten(list_transform(s.views, lambda v: list_transform(c[1:s.most], lambda x: CASE WHEN v = 'raw' THEN x ELSE x || '_' || v END))) AS columns
     FROM o, (VALUES {', '.join(f"('{n}', {list(v)}, {k})" for n, v, k in blend.CATALOG_SETS)}) s(name, views, most)),
   al AS (SELECT *, '' AS calibration FROM sets, (VALUES {_rows(blend.CATALOG_RULES)}) v(rule)
     UNION ALL SELECT * FROM sets, (VALUES {_rows(blend.CALIBRATED_RULES)}) v(rule), (VALUES {_rows(f'time{m}_a{a:g}' for m, a in blend.CALIBRATIONS)}) w(calibration)
     WHERE feature_set IN ({', '.join(f"'{n}'" for n in blend.CALIBRATED_SETS)}))
   SELECT feature_set || '__' || rule || CASE WHEN calibration <> '' THEN '__' || calibration ELSE '' END AS candidate, feature_set, rule, calibration,
     array_to_string(columns, ',') AS columns, len(columns)::BIGINT AS n_columns FROM al""")
def _(t: Tables):
    """Eleven sets by seven rules and sixty calibrated ones, over the components of the score table."""
    cat = blend.candidate_catalog(select.standalone(t.preds, P, train_rows()))
    return cat.select("candidate", "feature_set", "rule", "calibration", F.array_join("columns", ",").alias("columns"), F.size("columns").cast("long").alias("n_columns"))


@query("en34_family_combinations")
def _(t: Tables):
    cols = [*P, *[f"xsz_{x}" for x in P]]
    d = with_views(t)
    a, b = (Stats.of(gram(d.where(w), [], cols, "label").head()) for w in (train_rows(), ~train_rows()))
    return _names(t, blend.family_combinations(a, b, cols, {"mom": ("p1", "xsz_p1"), "act": ("p2", "xsz_p2"), "osc": ("p3", "xsz_p3")}), "candidate string, ic double")
