"""Rolling factor families, the operator banks and the second feature vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barwright.catalog.base import BASE_D, KEY, ROWS, Tables, m_, out, pct_rank, query, r, w_, z_sql
from barwright.operators import build, factors
from barwright.plans.staging import shared_dir, stage

WS = (5, 13, 42)


def fam(name: str, families: list[str], cols: dict[str, str], windows=WS, digits: int = 4, pre: str = "", src: str = "base",
        **kw) -> None:
    """Register one family: ``cols`` maps output names to the oracle's SQL expressions."""
    sql = f"WITH {BASE_D}{pre} SELECT {KEY}, " + ", ".join(r(e, n, digits) for n, e in cols.items()) + f" FROM {src}"

    @query(name, sql)
    def _(t: Tables):
        return out(factors.factor_panel(t.d, families, windows, rows=ROWS, **kw), list(cols), digits=digits)


def per(template: str, names: str, ws=WS) -> dict[str, str]:
    """One masked SQL expression per window; ``{W}`` is the frame and ``{w}`` its length."""
    return {names.format(w=w): m_(template.format(W=w_(w), w=w), w) for w in ws}


@query("ts01_base_series", f"""WITH {BASE_D} SELECT {KEY}, {', '.join(r(x, x, 6) for x in ('lr', 'dloi', 'logv', 'loga', 'turn', 'body', 'cpos'))} FROM base""")
def _(t: Tables):
    from barwright.plans.rolling import Rolling
    d = factors.base_series(Rolling(t.d, 2, 0, ROWS)).close()
    return out(d, ("lr", "dloi", "logv", "loga", "turn", "body", "cpos"), digits=6)


def tsz_sql(x: str, w: int, m: int) -> str:
    return f"CASE WHEN count({x}) OVER {w_(w)} >= {m} THEN ({x} - avg({x}) OVER {w_(w)}) / (stddev_samp({x}) OVER {w_(w)} + 1e-9) END"


ABS = "(abs(close) + 1e-9)"
Z = "({x} - avg({x}) OVER {{W}}) / (stddev_samp({x}) OVER {{W}} + 1e-9)"
CORR = ("CASE WHEN count({y}) OVER {{W}} >= {{w}} AND var_pop({x}) OVER {{W}} > 1e-9 AND var_pop({y}) OVER {{W}} > 1e-9 "
        "THEN corr({x}, {y}) OVER {{W}} END")

fam("ts02_mom", ["mom"], per("sum(lr) OVER {W}", "mom_{w}"))
fam("ts03_sharpe", ["sharpe"], per("avg(lr) OVER {W} / (stddev_samp(lr) OVER {W} + 1e-9)", "sharpe_{w}"))
fam("ts04_upratio", ["upratio"], per("avg((lr > 0)::INT) OVER {W}", "upratio_{w}"))
fam("ts05_extremes", ["extremes"], {**per("max(lr) OVER {W}", "maxret_{w}"), **per("min(lr) OVER {W}", "minret_{w}")})
fam("ts06_px_sma", ["px_sma"], per("close / (avg(close) OVER {W} + 1e-9) - 1", "px_sma_{w}"))
fam("ts07_roc", ["roc"], per("close / lag(close, {w}) OVER (PARTITION BY symbol ORDER BY datetime) - 1", "roc_{w}"))
fam("ts08_accel", ["accel"], {
    "mom_accel": m_(f"sum(lr) OVER {w_(8)} - sum(lr) OVER {w_(34)}", 34),
    "oi_accel": m_(f"sum(dloi) OVER {w_(8)} - sum(dloi) OVER {w_(34)}", 34)}, windows=None)

PAIRS = ((3, 13), (5, 21), (13, 55))
SPANS = sorted({s for p in PAIRS for s in p})


def _ema_sql(col: str) -> str:
    steps = ", ".join(f"e{s} + {2.0 / (s + 1)!r} * (b.{col} - e{s})" for s in SPANS)
    return (f", rec AS (WITH RECURSIVE e(symbol, bar_no, {', '.join(f'e{s}' for s in SPANS)}) AS ("
            f"SELECT symbol, bar_no, {', '.join(col for _ in SPANS)} FROM b1 WHERE bar_no = 0 UNION ALL "
            f"SELECT b.symbol, b.bar_no, {steps} FROM e JOIN b1 b ON b.symbol = e.symbol AND b.bar_no = e.bar_no + 1) "
            f"SELECT * FROM e), em AS (SELECT base.*, {', '.join(f'e{s}' for s in SPANS)} FROM base JOIN rec USING (symbol, bar_no))")


_S = "(PARTITION BY symbol ORDER BY datetime)"
fam("ts09_ema_macd", ["ema_diff", "macd"], {
    **{f"ema_diff_{a}_{b}": m_(f"(e{a} - e{b}) / {ABS}", b) for a, b in PAIRS},
    **{f"macd_{a}_{b}": m_(f"((e{a} - e{b}) - lag(e{a} - e{b}) OVER {_S}) / {ABS}", b) for a, b in PAIRS}},
    pre=_ema_sql("close"), src="em", pairs=PAIRS)
fam("ts31_vwap_macd", ["vwap_macd"], {f"vwap_macd_{a}_{b}": m_(f"(e{a} - e{b}) / {ABS}", b) for a, b in PAIRS},
    pre=_ema_sql("vwap"), src="em", pairs=PAIRS)

fam("ts10_rv", ["rv"], per("sqrt(sum(lr * lr) OVER {W})", "rv_{w}"))
fam("ts11_park", ["park"], per("sqrt(sum(ln(high / low) ^ 2) OVER {W} / (4 * ln(2) * {w}))", "park_{w}"))
DN, UP = "sqrt(sum(CASE WHEN lr < 0 THEN lr * lr ELSE 0 END) OVER {W})", "sqrt(sum(CASE WHEN lr > 0 THEN lr * lr ELSE 0 END) OVER {W})"
fam("ts12_downside", ["downside"], {**per(DN, "dvol_{w}"), **per(f"({UP} - {DN}) / ({UP} + {DN} + 1e-9)", "volskew_{w}")})
fam("ts13_skew_kurt", ["shape"], {**per("skewness(lr) OVER {W}", "skew_{w}"), **per("kurtosis(lr) OVER {W}", "kurt_{w}")})
fam("ts14_atr_range", ["atr"], {**per(f"avg(tr) OVER {{W}} / {ABS}", "atr_{w}"), **per(f"avg((high - low) / {ABS}) OVER {{W}}", "range_{w}")})
fam("ts15_vol_regime", ["vol_regime"], {"vol_regime": m_(f"sqrt(sum(lr * lr) OVER {w_(8)}) / (sqrt(sum(lr * lr) OVER {w_(55)}) + 1e-9)", 55)}, windows=None)
LOW, HIGH = "min(low) OVER {W}", "max(high) OVER {W}"
_st = {w: f"CASE WHEN bar_no >= {w - 1} THEN (close - min(low) OVER {w_(w)}) / (max(high) OVER {w_(w)} - min(low) OVER {w_(w)} + 1e-9) END" for w in WS}
fam("ts16_stoch", ["stoch"], {
    **per(f"(close - {LOW}) / ({HIGH} - {LOW} + 1e-9)", "stoch_{w}"), **per(f"({HIGH} - close) / ({HIGH} - {LOW} + 1e-9)", "willr_{w}"),
    **{f"stoch_dev_{w}": m_(f"k{w} - CASE WHEN count(k{w}) OVER {w_(5)} >= 3 THEN avg(k{w}) OVER {w_(5)} END", w) for w in WS}},
    pre=", k AS (SELECT *, " + ", ".join(f"{e} AS k{w}" for w, e in _st.items()) + " FROM base)", src="k")
fam("ts17_rsi", ["rsi"], per("100 - 100 / (1 + avg(up) OVER {W} / (avg(dn) OVER {W} + 1e-9))", "rsi_{w}"))
fam("ts18_cci", ["cci"], per("(typ - avg(typ) OVER {W}) / (0.015 * 0.8 * stddev_samp(typ) OVER {W} + 1e-9)", "cci_{w}"))
fam("ts19_bollz", ["bollz"], per(Z.format(x="close"), "bollz_{w}"))
fam("ts20_cmo", ["cmo"], per("(sum(up) OVER {W} - sum(dn) OVER {W}) / (sum(up) OVER {W} + sum(dn) OVER {W} + 1e-9)", "cmo_{w}"))
fam("ts21_autocorr", ["autocorr"], {**per(CORR.format(x="lr", y="lr1"), "ret_ac1_{w}"), **per(CORR.format(x="lr", y="lr2"), "ret_ac2_{w}")})
fam("ts22_activity_z", ["activity_z"], {**per(Z.format(x="logv"), "volz_{w}"), **per(Z.format(x="loga"), "amtz_{w}"), **per(Z.format(x="turn"), "turnover_z_{w}")})
LAGW = "lag({x}, {{w}}) OVER (PARTITION BY symbol ORDER BY datetime)"
fam("ts23_activity_mom", ["activity_mom"], {**per("logv - " + LAGW.format(x="logv"), "volmom_{w}"), **per("loga - " + LAGW.format(x="loga"), "amtmom_{w}")})
fam("ts24_activity_corr", ["activity_corr"], {n + "_{w}".format(w=w): v for n, y in (("pvcorr", "logv"), ("pacorr", "loga"), ("ret_oi_corr", "dloi"))
                                              for w in WS for v in per(CORR.format(x="lr", y=y), "{w}", (w,)).values()})
fam("ts25_illiq", ["illiq"], per("avg(abs(lr) / (loga + 1e-6)) OVER {W}", "illiq_{w}"))
fam("ts26_flows", ["flows"], {**per("sum(sign(lr) * logv) OVER {W}", "vol_flow_{w}"), **per("sum(sign(lr) * loga) OVER {W}", "amt_flow_{w}")})
PV, NV = "sum(CASE WHEN lr > 0 THEN logv ELSE 0 END) OVER {W}", "sum(CASE WHEN lr < 0 THEN logv ELSE 0 END) OVER {W}"
fam("ts27_updn_vol", ["updn_vol"], per(f"({PV} - {NV}) / ({PV} + {NV} + 1e-9)", "updn_vol_ratio_{w}"))
fam("ts28_amount_share", ["amount_share"], {
    **per("sign(lr) * amount / (sum(amount) OVER {W} + 1e-9)", "amt_prop_signed_{w}"),
    "amt_share_signed": f"CASE WHEN bar_no >= 11 THEN sign(lr) * amount / (sum(amount) OVER {w_(12)} + 1e-9) ELSE 0 END"})
fam("ts29_mfi", ["mfi"], per("100 - 100 / (1 + sum(fu) OVER {W} / (sum(fd) OVER {W} + 1e-9))", "mfi_{w}"))
fam("ts30_vwap_dev", ["vwap_dev"], {"vwap_dev": f"(close - vwap) / {ABS}", **per(f"(close - sum(amount) OVER {{W}} / (sum(volume) OVER {{W}} + 1e-9)) / {ABS}", "vwap_dev_{w}")})
fam("ts32_open_interest", ["open_interest"], {
    "oi_chg": "dloi", "oi_vol_ratio": "logoi - logv", **per("sum(dloi) OVER {W}", "oimom_{w}"), **per(Z.format(x="logoi"), "oiz_{w}"),
    **per("sum(dloi) OVER {W} * sign(sum(lr) OVER {W})", "oipx_div_{w}")})
fam("ts33_geometry", ["geometry"], {**{n: n for n in ("bop", "body", "upsh", "losh", "cpos")},
                                    **{k: v for n in ("bop", "body", "upsh", "losh", "cpos") for k, v in per(f"avg({n}) OVER {{W}}", n + "_{w}", (8, 21)).items()}},
    windows=(8, 21), geometry_raw=True)
fam("ts34_shadows", ["shadows"], {
    **per("avg(losh) OVER {W} - avg(upsh) OVER {W}", "shadow_imb_{w}"), **per("stddev_samp(losh) OVER {W} - stddev_samp(upsh) OVER {W}", "shadow_vol_diff_{w}"),
    **per("avg(body * (cpos - 0.5)) OVER {W}", "body_pos_inter_{w}")})
TH = "greatest(max(high) OVER {W} - min(close) OVER {W}, max(close) OVER {W} - min(low) OVER {W})"
fam("ts35_dual_thrust", ["dual_thrust"], per(f"(close - (min(low) OVER {{W}} + 0.5 * {TH})) / ({TH} + 1e-9)", "dual_thrust_pos_{w}"))
fam("ts36_tr_dir", ["tr_dir"], per(f"sign(sum(lr) OVER {{W}}) * avg(tr) OVER {{W}} / {ABS}", "tr_dir_{w}"))
VZ = Z.format(x="logv").replace("{{", "{").replace("}}", "}")
fam("ts37_interactions", ["interactions"], {
    **per(f"sum(lr) OVER {{W}} * {VZ}", "mom_x_volz_{w}"), **per("sum(lr) OVER {W} * sum(dloi) OVER {W}", "mom_x_oimom_{w}"),
    **per(f"sqrt(sum(lr * lr) OVER {{W}}) * {VZ}", "rv_x_volz_{w}")})
fam("ts38_efficiency", ["efficiency"], per("abs(sum(lr) OVER {W}) / (sum(abs(lr)) OVER {W} + 1e-9)", "effratio_{w}"))
fam("ts39_drawdown", ["drawdown"], {**per("close / (max(close) OVER {W} + 1e-9) - 1", "drawdn_{w}"), **per("close / (min(close) OVER {W} + 1e-9) - 1", "drawup_{w}")})
_lb = per("sum(lr) OVER {W}", "mom_{w}", (13,)) | per("sqrt(sum(lr * lr) OVER {W})", "rv_{w}", (13,))
fam("ts40_lagged", ["mom", "rv"], {f"{n}_lag{k}": m_(f"lag({n}, {k}) OVER {_S}", k) for n in _lb for k in (1, 2, 3, 5)}, windows=(13,),
    pre=", lagged AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _lb.items()) + " FROM base)", src="lagged", lag_bases=tuple(_lb))


ALL_WS = (5, 21, 55)
_ALL_SQL = {
    **per("sum(lr) OVER {W}", "mom_{w}", ALL_WS), **per("sqrt(sum(lr * lr) OVER {W})", "rv_{w}", ALL_WS),
    **per(Z.format(x="close"), "bollz_{w}", ALL_WS), **per("100 - 100 / (1 + avg(up) OVER {W} / (avg(dn) OVER {W} + 1e-9))", "rsi_{w}", ALL_WS),
    **per("skewness(lr) OVER {W}", "skew_{w}", ALL_WS), **per(CORR.format(x="lr", y="logv"), "pvcorr_{w}", ALL_WS),
    **per("close / (max(close) OVER {W} + 1e-9) - 1", "drawdn_{w}", ALL_WS)}


@query("ts41_factor_panel", f"WITH {BASE_D} SELECT {KEY}, " + ", ".join(r(e, n, 4) for n, e in _ALL_SQL.items()) + " FROM base")
def _(t: Tables):
    """Every family planned together; the columns checked by SQL are a choice across families."""
    wide = factors.factor_panel(t.d, None, ALL_WS, pairs=((3, 13), (5, 21)), geometry_raw=True,
                                lag_bases=("mom_21", "rv_21"), rows=ROWS)
    return out(wide, list(_ALL_SQL))


@query("ts41_full_vocabulary")
def _(t: Tables):
    """All 1,034 columns."""
    return build.vocabulary_report(t.d, ROWS)


BUILD = {"mom": "sum(lr) OVER {W}", "rv": "sqrt(sum(lr * lr) OVER {W})", "bollz": Z.format(x="close"),
         "rsi": "100 - 100 / (1 + avg(up) OVER {W} / (avg(dn) OVER {W} + 1e-9))"}
BUILD_SQL = {k: v for n, e in BUILD.items() for k, v in per(e, n + "_{w}", (5, 8, 21)).items()}
BUILD_BUDGETS = {"tsz_": 4, "csz_": 8, "csr_": 6}
BUILD_META = ("symbol", "datetime", "label", "bar_no", "session_id")
_views = {"": lambda n: n, "tsz_": lambda n: tsz_sql(n, 120, 30), "csz_": lambda n: z_sql(n, "datetime"), "csr_": lambda n: pct_rank(n, "datetime") + " - 0.5"}
_names = [v + n for v in _views for n in BUILD_SQL]


@query("pipeline_factor_build", f"""WITH RECURSIVE {BASE_D}, fr AS (SELECT symbol, datetime, label, session_id, bar_no, {', '.join(f'{e} AS {n}' for n, e in BUILD_SQL.items())} FROM base),
  vw AS (SELECT symbol, datetime, label, {', '.join(f'coalesce({f(n)}, 0)::DOUBLE AS {v}{n}' for v, f in _views.items() for n in BUILD_SQL)} FROM fr),
  lg AS (SELECT symbol, datetime, label, name, x FROM (UNPIVOT vw ON {', '.join(_names)} INTO NAME name VALUE x)),
  sc AS (SELECT name, sum(x * label) / sqrt(greatest(sum(x * x) * sum(label * label), 1e-24)) AS ic, avg((x <> 0)::INT) AS coverage FROM lg WHERE label IS NOT NULL GROUP BY name),
  raw AS (SELECT name, row_number() OVER (ORDER BY abs(ic) DESC) AS place FROM sc WHERE coverage >= 0.3 AND name[1:4] NOT IN ('tsz_', 'csz_', 'csr_')),
  allowed AS (SELECT name FROM raw UNION ALL SELECT v.view || name FROM raw JOIN (VALUES {', '.join(f"('{v}', {n})" for v, n in BUILD_BUDGETS.items())}) v(view, most) ON place <= most),
  cand AS (SELECT sc.*, row_number() OVER (ORDER BY abs(ic) DESC) AS j FROM sc JOIN allowed USING (name) WHERE coverage >= 0.3 AND abs(ic) >= 1e-4),
  used AS (SELECT j, symbol, datetime, x FROM lg JOIN cand USING (name) WHERE label IS NOT NULL),
  pair AS (SELECT a.j AS a, b.j AS b, corr(a.x, b.x) AS c FROM used a JOIN used b ON a.symbol = b.symbol AND a.datetime = b.datetime AND a.j > b.j GROUP BY 1, 2),
  edge AS (SELECT a, list(b) AS before FROM pair WHERE abs(c) >= 0.9 GROUP BY a),
  walk(j, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
    SELECT c.j, CASE WHEN list_has_any(kept, coalesce(e.before, [])) THEN kept ELSE list_append(kept, c.j) END
    FROM walk w JOIN cand c ON c.j = w.j + 1 LEFT JOIN edge e ON e.a = c.j),
  best AS (SELECT unnest(kept) AS j FROM (SELECT kept FROM walk ORDER BY j DESC LIMIT 1)),
  told AS (SELECT name, count(*) AS n, stddev_pop(least(greatest(x, -20), 20)) AS sd FROM lg GROUP BY name)
  SELECT name, row_number() OVER (ORDER BY j) AS place, {r('ic', 'ic', 6)}, {r('coverage', 'coverage', 6)}, n, {r('sd', 'sd', 4)} FROM best JOIN cand USING (j) JOIN told USING (name)""")
def _(t: Tables):
    """Twelve raw columns, their views within budgets, all decorrelated together, written by month and read back."""
    wide = factors.factor_panel(t.d, list(BUILD), (5, 8, 21), keep=BUILD_META, rows=ROWS).select(*BUILD_META, *BUILD_SQL)
    return out(_built(t, [wide], BUILD_BUDGETS), ("place", "ic", "coverage", "n", "sd"), ("name",), 6).withColumn("sd", F.round("sd", 4))


def _built(t: Tables, groups, budgets=None):
    path = f"{shared_dir(t.spark)}/views-{uuid.uuid4().hex}"
    chosen = build.factor_build(groups, t.g, path, budgets, BUILD_META, rows=ROWS)
    names = [r["name"] for r in chosen.collect()]
    back = t.spark.read.parquet(path)
    told = None
    for low in range(0, len(names), 100):
        some = names[low:low + 100]
        flat = back.agg(*[F.count(n).alias(f"n_{n}") for n in some], *[F.stddev_pop(n).alias(f"s_{n}") for n in some])
        part = flat.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n_{n}").alias("n"), F.col(f"s_{n}").alias("sd")) for n in some])))
        told = part if told is None else told.unionByName(part)
    return chosen.join(told, "name")

