"""Second feature vocabulary and normalisation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.catalog.base import (BARS_H, GAP_D, GAP_H, KEY, PANEL_D, PANEL_H, PREDS, ROWS, BASE_D, TRAIN, Tables, avg_rank, clip_sql, i, out,
                                    panel_sql, pct_rank, probit_sql, query, r, rs, train_rows, w_, z_sql)
from barwright.operators import features, sessions, views
from barwright.plans.staging import stage
from barwright.sources import bars as src

S = "(PARTITION BY symbol ORDER BY datetime)"
FEAT = PANEL_D + f""",
f0 AS (SELECT *, ln(1 + volume) AS log1p_volume, ln(1 + amount) AS log1p_amount, ln(1 + oi) AS log1p_oi, ln(close) AS lc,
         CASE WHEN high <> low THEN high - low END AS spread FROM panel),
feat AS (SELECT *, CASE WHEN NOT is_long_break_before THEN lc - lag(lc) OVER {S} END AS ret_1, ln(close / open) AS oc_ret,
         ln(high / low) AS hl_range, (close - low) / (spread + 1e-8) AS close_pos,
         (high - greatest(open, close)) / (spread + 1e-8) AS upper_shadow, (least(open, close) - low) / (spread + 1e-8) AS lower_shadow,
         CASE WHEN NOT is_long_break_before THEN log1p_volume - lag(log1p_volume) OVER {S} END AS volume_change,
         CASE WHEN NOT is_long_break_before THEN log1p_amount - lag(log1p_amount) OVER {S} END AS amount_change,
         CASE WHEN NOT is_long_break_before THEN log1p_oi - lag(log1p_oi) OVER {S} END AS oi_change FROM f0)"""
FCOLS = ("ret_1", "oc_ret", "hl_range", "close_pos", "upper_shadow", "lower_shadow", "log1p_volume", "log1p_amount", "log1p_oi",
         "volume_change", "amount_change", "oi_change")


@query("tf01_base_features", f"WITH {FEAT} SELECT {KEY}, {rs(FCOLS)} FROM feat")
def _(t: Tables):
    return out(features.base_features(t.d, ROWS), FCOLS)


@query("tf02_rolling_mean_sum", f"""WITH {FEAT} SELECT {KEY}, {r(f'CASE WHEN count(ret_1) OVER {w_(21)} >= 7 THEN avg(ret_1) OVER {w_(21)} END', 'ret_1_mean_21')},
   {r(f'CASE WHEN count(ret_1) OVER {w_(21)} >= 7 THEN sum(ret_1) OVER {w_(21)} END', 'ret_1_sum_21')} FROM feat""")
def _(t: Tables):
    return out(features.rolling_mean_sum(features.base_features(t.d, ROWS), "ret_1", 21, 7, ROWS), ("ret_1_mean_21", "ret_1_sum_21"))


def _lite_cte(ws=(5, 20)) -> str:
    a, b = [], []
    for w in ws:
        m, f = max(3, w // 3), w_(w)
        sd = lambda x: f"sqrt(greatest(var_pop({x}) OVER {f}, 1e-12))"
        ok = lambda x: f"count({x}) OVER {f} >= {m}"
        a += [f"CASE WHEN {ok('ret_1')} THEN {clip_sql(f'(ret_1 - avg(ret_1) OVER {f}) / ({sd("ret_1")} + 1e-8)', 12)} END AS op_ret_zscore_{w}",
              f"lc - lag(lc, {w}) OVER {S} AS op_momentum_{w}", f"CASE WHEN {ok('ret_1')} THEN avg(abs(ret_1)) OVER {f} END AS op_abs_ret_mean_{w}",
              f"CASE WHEN {ok('volume_change')} THEN {clip_sql(f'(volume_change - avg(volume_change) OVER {f}) / ({sd("volume_change")} + 1e-8)', 12)} END AS op_volume_zscore_{w}",
              f"CASE WHEN {ok('ret_1')} THEN (ret_1 - avg(ret_1) OVER {f}) * (volume_change - avg(volume_change) OVER {f}) END AS co_{w}",
              f"CASE WHEN {ok('ret_1')} THEN {sd('ret_1')} * {sd('volume_change')} END AS ss_{w}"]
        b.append(clip_sql(f"CASE WHEN count(co_{w}) OVER {f} >= {m} THEN avg(co_{w}) OVER {f} END / (ss_{w} + 1e-8)", 1) + f" AS op_ret_volume_corr_{w}")
    return FEAT + ", l1 AS (SELECT *, " + ", ".join(a) + " FROM feat), lite AS (SELECT *, " + ", ".join(b) + " FROM l1)"


LCOLS = [f"op_{n}_{w}" for w in (5, 20) for n in ("ret_zscore", "momentum", "abs_ret_mean", "volume_zscore", "ret_volume_corr")]


@query("tf03_lite_operators", f"WITH {_lite_cte()} SELECT {KEY}, {rs(LCOLS)} FROM lite")
def _(t: Tables):
    return out(features.lite_operators(t.d, (5, 20), ROWS), LCOLS)


def _rel(x: str) -> str:
    return clip_sql(f"({x} - avg({x}) OVER (PARTITION BY datetime)) / (nullif(stddev_samp({x}) OVER (PARTITION BY datetime), 0) + 1e-8)", 8)


@query("tf04_build_features", f"""WITH {_lite_cte()} SELECT {KEY}, {rs(('ret_1', 'op_ret_zscore_5'))}, {r('coalesce(' + _rel('ret_1') + ', 0)', 'cl_rel_ret_1')},
   {r('coalesce(' + _rel('oi_change') + ', 0)', 'cl_rel_oi_change')}, {r('coalesce(close_pos, 0)', 'cl_close_pos')} FROM lite""")
def _(t: Tables):
    df, z, c = features.build_features(t.d, t.g, (5, 20), ROWS)
    return out(views.clip_only(df, c), ("ret_1", "op_ret_zscore_5", "cl_rel_ret_1", "cl_rel_oi_change", "cl_close_pos"))


SS = "(PARTITION BY symbol, session_id ORDER BY datetime)"
STABLE = PANEL_D + f""",
t0 AS (SELECT *, ln(1 + volume) AS log1p_volume, ln(1 + amount) AS log1p_amount, ln(1 + oi) AS log1p_oi, ln(close) AS lc FROM panel),
stable AS (SELECT *, coalesce(lc - lag(lc) OVER {SS}, 0) AS log_ret_1, (high - low) / (close + 1e-8) AS range_pct,
   (close - low) / (high - low + 1e-8) - 0.5 AS close_pos, close / open - 1 AS oc_ret,
   coalesce(log1p_volume - lag(log1p_volume) OVER {SS}, 0) AS d_log1p_volume, coalesce(log1p_amount - lag(log1p_amount) OVER {SS}, 0) AS d_log1p_amount,
   coalesce(log1p_oi - lag(log1p_oi) OVER {SS}, 0) AS d_log1p_oi FROM t0)"""
ECOLS = features.EXTENDED


@query("tf05_stable_columns", f"WITH {STABLE} SELECT {KEY}, {rs(ECOLS)}, {rs(('log1p_volume', 'log1p_oi'))} FROM stable")
def _(t: Tables):
    return out(features.stable_columns(t.d, "extended", rows=ROWS)[0], (*ECOLS, "log1p_volume", "log1p_oi"))


def sw_(k: int) -> str:
    return f"(PARTITION BY symbol, session_id ORDER BY datetime ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def pw_(k: int, part: str = "symbol, session_id") -> str:
    return f"(PARTITION BY {part} ORDER BY datetime ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def prior_sql(x: str, w: int, m: int, b: float, part: str = "symbol, session_id") -> str:
    f = pw_(w, part)
    return (f"CASE WHEN count({x}) OVER {f} >= {m} THEN coalesce({clip_sql(f'({x} - avg({x}) OVER {f}) / (stddev_pop({x}) OVER {f} + 1e-8)', b)}, 0) ELSE 0 END")


BLOCK = STABLE + f""", o1 AS (SELECT *, {', '.join(f'coalesce(lc - lag(lc, {k}) OVER {SS}, 0) AS log_ret_{k}' for k in (2, 5))},
   {', '.join(f'CASE WHEN count(*) OVER {sw_(w)} >= {max(3, w // 3)} THEN sqrt(avg(log_ret_1 * log_ret_1) OVER {sw_(w)}) ELSE 0 END AS rv_{w}, CASE WHEN count(*) OVER {sw_(w)} >= {max(3, w // 3)} THEN avg(range_pct) OVER {sw_(w)} ELSE 0 END AS range_mean_{w}' for w in (5, 15))},
   {', '.join(f'{prior_sql(b, 20, 10, 20)} AS {b}_surprise_20' for b in ('log1p_volume', 'log1p_amount'))},
   (close - open) / greatest(high - low, 1e-8) AS body_pct, (high - greatest(open, close)) / greatest(high - low, 1e-8) AS upper_wick_pct FROM stable),
 o2 AS (SELECT *, log_ret_1 * range_pct AS ret_x_range, body_pct * log1p_volume_surprise_20 AS body_x_volume_surprise,
   abs(log_ret_1) / (1 + abs(log1p_amount)) AS absret_per_amount, coalesce(lag(log_ret_1, 2) OVER {SS}, 0) AS log_ret_1_lag2,
   coalesce(lag(log1p_volume_surprise_20) OVER {SS}, 0) AS log1p_volume_surprise_20_lag1,
   coalesce((rv_15 - avg(rv_15) OVER (PARTITION BY datetime)) / (nullif(stddev_samp(rv_15) OVER (PARTITION BY datetime), 0) + 1e-8), 0) AS xrel_rv_15,
   {pct_rank('range_pct', 'datetime')} - 0.5 AS xrank_range_pct FROM o1)"""
BCOLS = ("log_ret_2", "log_ret_5", "rv_5", "rv_15", "range_mean_5", "range_mean_15", "log1p_volume_surprise_20", "log1p_amount_surprise_20", "body_pct",
         "upper_wick_pct", "ret_x_range", "body_x_volume_surprise", "absret_per_amount", "log_ret_1_lag2", "log1p_volume_surprise_20_lag1",
         "xrel_rv_15", "xrank_range_pct")


@query("tf06_ohlcv_block", f"WITH {BLOCK} SELECT {KEY}, {rs(BCOLS)} FROM o2")
def _(t: Tables):
    return out(features.ohlcv_block(t.d, t.g, (5, 15), (20,), (2, 5), ROWS)[0], BCOLS)


@query("tf07_prior_z", f"WITH {STABLE} SELECT {KEY}, {r(prior_sql('log1p_volume', 30, 10, 20), 'pz_log1p_volume')}, {r(prior_sql('range_pct', 30, 10, 20), 'pz_range_pct')} FROM stable")
def _(t: Tables):
    d = features.stable_columns(t.d, "extended", rows=ROWS)[0]
    return out(features.group_prior_z(d, ("log1p_volume", "range_pct"), 30, 10, rows=ROWS), ("pz_log1p_volume", "pz_range_pct"))


LADDER = PANEL_D + f""", ladder AS (SELECT *, CASE WHEN is_long_break_before THEN 0 ELSE coalesce(ln(close / lag(close) OVER {S}), 0) END AS ret1,
   {', '.join(f'coalesce(ln(close / lag(close, {k}) OVER {S}), 0) AS ret{k}' for k in (3, 6, 24))}, ln(close / open) AS intrabar_ret, (high - low) / close AS range_rel,
   (close - open) / open AS body_rel, ln(1 + volume) AS log_volume, ln(1 + amount) AS log_amount,
   CASE WHEN is_long_break_before THEN 0 ELSE coalesce(ln(1 + oi) - ln(1 + lag(oi) OVER {S}), 0) END AS oi_chg,
   CASE WHEN symbol = 'S11' THEN 'other' ELSE 'g' || (substr(symbol, 2)::INT % 3) END AS grp,
   CASE WHEN symbol = 'S11' THEN 'other' WHEN substr(symbol, 2)::INT % 5 = 0 THEN 'chain0' WHEN substr(symbol, 2)::INT % 5 = 1 THEN 'chain1'
     ELSE 'g' || (substr(symbol, 2)::INT % 3) END AS chain FROM panel)"""
RCOLS = ("ret1", "ret3", "ret6", "ret24", "intrabar_ret", "range_rel", "body_rel", "log_volume", "log_amount", "oi_chg")


def ladder(t: Tables):
    return src.group_of(features.return_ladder(t.d, (3, 6, 24), ROWS), t.dim)


@query("tf08_return_ladder", f"WITH {LADDER} SELECT {KEY}, {rs(RCOLS)} FROM ladder")
def _(t: Tables):
    return out(features.return_ladder(t.d, (3, 6, 24), ROWS), RCOLS)


# ---- operator banks: inputs are causal z columns, as the windows of a model would hold them ------------
def rz_sql(x: str, w: int = 40, m: int = 10) -> str:
    f = pw_(w, "symbol")
    return (f"CASE WHEN count({x}) OVER {f} >= {m} THEN coalesce({clip_sql(f'({x} - avg({x}) OVER {f}) / (sqrt(greatest(var_pop({x}) OVER {f}, 1e-12)) + 1e-8)', 8)}, 0) ELSE 0 END")


A_IN = (*features.RAW, *features.EXTENDED)
BANK_A = STABLE + f", bi AS (SELECT symbol, datetime, {', '.join(f'{rz_sql(x)} AS {x}' for x in A_IN)} FROM stable), ba AS (SELECT *, greatest(high - low, 1e-4) AS sp, amount_minus AS turn FROM (SELECT *, log1p_amount - log1p_volume AS amount_minus FROM bi))"
AW = (5, 21)


def _bank_a_sql() -> dict[str, str]:
    e = {"a_body": "close - open", "a_bop": "(close - open) / (sp + 1e-4)", "a_turn": "turn", "a_ret_dvol": "log_ret_1 * d_log1p_volume",
         "a_cpos_lag1": f"coalesce(lag(close_pos) OVER {S}, 0)", "a_turn_dir": "turn * tanh(log_ret_1 * 4)", "a_abs_ret": "abs(log_ret_1)"}
    for w in AW:
        f = w_(w)
        sd = lambda x: f"sqrt(greatest(var_pop({x}) OVER {f}, 0) + 1e-6)"
        z = lambda x: f"(({x}) - avg({x}) OVER {f}) / ({sd(x)} + 1e-6)"
        corr = lambda x, y: f"covar_pop({x}, {y}) OVER {f} / ({sd(x)} * {sd(y)} + 1e-6)"
        mom, oim = f"sum(log_ret_1) OVER {f}", f"sum(d_log1p_oi) OVER {f}"
        up, dn = (f"sqrt(avg(greatest({s}log_ret_1, 0) ^ 2) OVER {f} + 1e-6)" for s in ("", "-"))
        e |= {f"a{w}_mom": mom, f"a{w}_sharpe": f"avg(log_ret_1) OVER {f} / ({sd('log_ret_1')} + 1e-6)", f"a{w}_upratio": f"avg(1 / (1 + exp(-8 * log_ret_1))) OVER {f}",
              f"a{w}_maxret": f"max(log_ret_1) OVER {f}", f"a{w}_rv": f"sqrt(avg(log_ret_1 * log_ret_1) OVER {f} + 1e-6)", f"a{w}_volskew": f"({up} - {dn}) / ({up} + {dn} + 1e-6)",
              f"a{w}_volz": z("log1p_volume"), f"a{w}_stoch": f"(close - min(low) OVER {f}) / (max(high) OVER {f} - min(low) OVER {f} + 1e-4)", f"a{w}_bollz": z("close"),
              f"a{w}_pvcorr": corr("log_ret_1", "log1p_volume"), f"a{w}_vol_flow": f"sum(tanh(log_ret_1 * 4) * log1p_volume) OVER {f}",
              f"a{w}_mfi": f"sum(greatest(log_ret_1, 0) * log1p_volume) OVER {f} / (sum(abs(log_ret_1) * abs(log1p_volume)) OVER {f} + 1e-6)",
              f"a{w}_mom_oimom": f"{mom} * {oim}", f"a{w}_roc": f"close - coalesce(lag(close, {w}) OVER {S}, 0)", f"a{w}_cci": z("(high + low + close) / 3.0"),
              f"a{w}_illiq": f"avg(abs(log_ret_1) / (abs(log1p_amount) + 1)) OVER {f}", f"a{w}_turnz": z("turn"),
              f"a{w}_shadow_sd": f"{sd('(least(open, close) - low)')} - {sd('(high - greatest(open, close))')}"}
    e["a5_21_trend"] = f"{e['a5_mom']} - {e['a21_mom']}"
    e["a5_21_rv"] = f"{e['a5_rv']} / ({e['a21_rv']} + 1e-6)"
    e["a5_21_stoch"] = f"{e['a5_stoch']} - {e['a21_stoch']}"
    return e


_A = _bank_a_sql()


@query("tf09_operator_bank_a", f"WITH {BANK_A} SELECT {KEY}, " + ", ".join(r(clip_sql(e, 12), n) for n, e in _A.items()) + " FROM ba")
def _(t: Tables):
    z = views.causal_z(features.stable_columns(t.d, "extended", rows=ROWS)[0], A_IN, 40, 10, prefix="rz_", rows=ROWS)
    z = z.select("symbol", "datetime", "bar_no", *[F.col(f"rz_{x}").alias(x) for x in A_IN])
    bank, names = features.operator_bank_a(z, AW, extra=True, rows=ROWS)
    assert len(names) == 13 + 6 + len(AW) * 53 + 8
    return out(bank, list(_A))


B_IN = (*features.Z_FEATURES, "close_pos", *[f"rel_{x}" for x in features.REL_FEATURES])
BANK_B = FEAT + (f", br AS (SELECT *, {', '.join(f'{_rel(x)} AS rel_{x}' for x in features.REL_FEATURES)} FROM feat), "
                 f"bb AS (SELECT symbol, datetime, {', '.join(f'{rz_sql(x)} AS {x}' for x in features.Z_FEATURES)}, coalesce(close_pos, 0) AS close_pos, "
                 f"{', '.join(f'coalesce(rel_{x}, 0) AS rel_{x}' for x in features.REL_FEATURES)} FROM br)")


def _bank_b_sql() -> dict[str, str]:
    safe = lambda a, b: f"({a}) / greatest(abs({b}), 1e-4)"
    e = {"b_ret_1": "ret_1", "b_rel_oi_change": "rel_oi_change", "b_ret_amt": "ret_1 * amount_change",
         "b_body_share": safe("abs(oc_ret)", "abs(hl_range) + abs(upper_shadow) + abs(lower_shadow) + 1e-3")}
    for w in (5, 13):
        f = w_(w)
        sd = lambda x: f"sqrt(greatest(var_pop({x}) OVER {f}, 1e-5))"
        avg = lambda x: f"avg({x}) OVER {f}"
        corr = lambda x, y: safe(f"covar_pop({x}, {y}) OVER {f}", f"{sd(x)} * {sd(y)}")
        e |= {f"b{w}_ret_1_mean": avg("ret_1"), f"b{w}_hl_range_std": sd("hl_range"), f"b{w}_oi_change_mom": f"oi_change - coalesce(lag(oi_change, {w - 1}) OVER {S}, 0)",
              f"b{w}_oc_ret_z": safe(f"oc_ret - {avg('oc_ret')}", sd("oc_ret")), f"b{w}_rv": f"sqrt(greatest({avg('ret_1 * ret_1')}, 1e-5))",
              f"b{w}_corr_vol": corr("ret_1", "volume_change"), f"b{w}_range_vol": corr("hl_range", "volume_change"), f"b{w}_mfi": avg("sign(ret_1) * log1p_volume"),
              f"b{w}_bollinger": safe(f"close_pos - {avg('close_pos')}", sd("close_pos")), f"b{w}_trend": safe(f"abs({avg('ret_1')})", f"sqrt(greatest({avg('ret_1 * ret_1')}, 1e-5))")}
    e["b5_13_rel_ret_1"] = f"avg(rel_ret_1) OVER {w_(5)} - avg(rel_ret_1) OVER {w_(13)}"
    e["b5_13_oi_change"] = f"avg(oi_change) OVER {w_(5)} - avg(oi_change) OVER {w_(13)}"
    return e


_B = _bank_b_sql()


@query("tf10_operator_bank_b", f"WITH {BANK_B} SELECT {KEY}, " + ", ".join(r(clip_sql(e, 8), n) for n, e in _B.items()) + " FROM bb")
def _(t: Tables):
    d = views.relative_features(features.base_features(t.d, ROWS), t.g, features.REL_FEATURES)
    z = views.causal_z(d, features.Z_FEATURES, 40, 10, rows=ROWS)
    z = z.select("symbol", "datetime", "bar_no", *[F.col(f"rz_{x}").alias(x) for x in features.Z_FEATURES], "close_pos", *[f"rel_{x}" for x in features.REL_FEATURES])
    bank, names = features.operator_bank_b(z, (5, 13), ((5, 13),), rows=ROWS)
    assert len(names) == 19 + 53 * 2 + 8
    return out(bank, list(_B))


# ---- the whole banks, a pair of windows a query; the pairs cover all windows ----------------------------
def bank_frame(t: Tables, name: str):
    """Normalised inputs of a bank, written once per session: all groups of columns start from this table."""
    if name not in t.__dict__:
        if name == "bank_a":
            z = views.causal_z(features.stable_columns(t.d, "extended", rows=ROWS)[0], A_IN, 40, 10, prefix="rz_", rows=ROWS)
            z = z.select("symbol", "datetime", "bar_no", *[F.col(f"rz_{x}").alias(x) for x in A_IN])
        else:
            d = views.relative_features(features.base_features(t.d, ROWS), t.g, features.REL_FEATURES)
            z = views.causal_z(d, features.Z_FEATURES, 40, 10, rows=ROWS)
            z = z.select("symbol", "datetime", "bar_no", *[F.col(f"rz_{x}").alias(x) for x in features.Z_FEATURES], "close_pos",
                         *[f"rel_{x}" for x in features.REL_FEATURES])
        t.__dict__[name] = stage(z, name)
    return t.__dict__[name]


def _sd(x: str, f: str, floor: str) -> str:
    return f"sqrt(greatest(var_pop({x}) OVER {f}, 0) + {floor})"


def _bank_a_full(s: int, l: int) -> tuple[dict[str, str], dict[str, str]]:
    """All operators of bank A for two windows: those of one stage, and those that read columns of it."""
    lag = lambda x, k: f"coalesce(lag({x}, {k}) OVER {S}, 0)"
    e = {"a_body": "close - open", "a_bop": "bop", "a_upper": "up_sh", "a_lower": "lo_sh", "a_turn": "turn", "a_ret_range": "log_ret_1 * range_pct",
         "a_ret_cpos": "log_ret_1 * close_pos", "a_ret_dvol": "log_ret_1 * d_log1p_volume", "a_ret_doi": "log_ret_1 * d_log1p_oi",
         "a_range_dvol": "range_pct * d_log1p_volume", "a_oc_vol": "oc_ret * log1p_volume", "a_ret_lag1": lag("log_ret_1", 1), "a_cpos_lag1": lag("close_pos", 1),
         "a_typ": "typ", "a_abs_ret": "abs(log_ret_1)", "a_ret_sq": "log_ret_1 * log_ret_1", "a_dir_range": "sign(log_ret_1) * abs(range_pct)",
         "a_dvol_doi": "d_log1p_volume - d_log1p_oi", "a_turn_dir": "turn * tanh(log_ret_1 * 4)"}
    late: dict[str, str] = {}
    for w in (s, l):
        f = w_(w)
        avg, tot = (lambda x: f"avg({x}) OVER {f}"), (lambda x: f"sum({x}) OVER {f}")
        sd = lambda x: _sd(x, f, "1e-6")
        root = lambda x: f"sqrt(greatest({avg(x)}, 0) + 1e-6)"
        zed = lambda x: f"({x} - {avg(x)}) / ({sd(x)} + 1e-6)"
        corr = lambda x, y: f"covar_pop({x}, {y}) OVER {f} / ({sd(x)} * {sd(y)} + 1e-6)"
        hi, lo = f"max(high) OVER {f}", f"min(low) OVER {f}"
        up, dn, mom, oim, rv = root("greatest(log_ret_1, 0) ^ 2"), root("greatest(-log_ret_1, 0) ^ 2"), tot("log_ret_1"), tot("d_log1p_oi"), root("log_ret_1 * log_ret_1")
        thrust = f"greatest({hi} - min(close) OVER {f}, max(close) OVER {f} - {lo})"
        stoch = f"(close - {lo}) / ({hi} - {lo} + 1e-4)"
        one = {"mom": mom, "sharpe": f"{avg('log_ret_1')} / ({sd('log_ret_1')} + 1e-6)", "upratio": avg("1 / (1 + exp(-8 * log_ret_1))"), "maxret": f"max(log_ret_1) OVER {f}",
               "minret": f"min(log_ret_1) OVER {f}", "rv": rv, "up": up, "down": dn, "volskew": f"({up} - {dn}) / ({up} + {dn} + 1e-6)", "volz": zed("log1p_volume"),
               "amtz": zed("log1p_amount"), "oiz": zed("log1p_oi"), "oimom": oim, "stoch": stoch, "willr": f"1 - {stoch}", "bollz": zed("close"), "drawup": f"close - {lo}",
               "drawdn": f"close - {hi}", "eff": f"abs({mom}) / ({tot('abs(log_ret_1)')} + 1e-6)", "pvcorr": corr("log_ret_1", "log1p_volume"),
               "pacorr": corr("log_ret_1", "log1p_amount"), "oicorr": corr("log_ret_1", "d_log1p_oi"), "bop": avg("bop"), "cpos": avg("close_pos"), "shadow": avg("(lo_sh - up_sh)"),
               "vol_flow": tot("tanh(log_ret_1 * 4) * log1p_volume"), "amt_flow": tot("tanh(log_ret_1 * 4) * log1p_amount"), "tr_dir": f"sign({mom}) * {avg('abs(range_pct)')}",
               "mom_volz": f"{mom} * ({zed('log1p_volume')})", "mom_oimom": f"{mom} * {oim}", "rv_volz": f"{rv} * ({zed('log1p_volume')})",
               "mfi": f"{tot('greatest(log_ret_1, 0) * log1p_volume')} / ({tot('abs(log_ret_1) * abs(log1p_volume)')} + 1e-6)", "px_ma": f"close - {avg('close')}",
               "roc": f"close - {lag('close', w)}", "range_rms": root("range_pct * range_pct"), "range_mean": avg("abs(range_pct)"), "cci": zed("typ"),
               "cmo": f"({tot('greatest(log_ret_1, 0)')} - {tot('greatest(-log_ret_1, 0)')}) / ({tot('abs(log_ret_1)')} + 1e-6)", "ac1": corr("log_ret_1", "l1"),
               "ac2": corr("log_ret_1", "l2"), "volmom": f"log1p_volume - {lag('log1p_volume', w)}", "amtmom": f"log1p_amount - {lag('log1p_amount', w)}", "turnz": zed("turn"),
               "illiq": avg("abs(log_ret_1) / (abs(log1p_amount) + 1)"), "updn_vol": f"{tot('sign(log_ret_1) * abs(log1p_volume)')} / ({tot('abs(log1p_volume)')} + 1e-6)",
               "oi_dir": f"{oim} * sign({mom})", "shadow_sd": f"{sd('lo_sh')} - {sd('up_sh')}", "body_pos": avg("abs(close - open) * (close_pos - 0.5)"),
               "thrust": f"(close - ({lo} + 0.5 * {thrust})) / (abs({thrust}) + 1e-6)"}
        e |= {f"a{w}_{k}": v for k, v in one.items()} | {f"m{w}": avg("close")}
        late |= {f"a{w}_stoch_dev": f"a{w}_stoch - avg(a{w}_stoch) OVER {w_(min(5, w))}"} | {f"a{w}_{x}_lag1": lag(f"a{w}_{x}", 1) for x in ("mom", "rv", "volz")}
    p, q = f"a{s}_", f"a{l}_"
    late |= {f"a{s}_{l}_trend": f"{p}mom - {q}mom", f"a{s}_{l}_volz": f"{p}volz - {q}volz", f"a{s}_{l}_rv": f"{p}rv / ({q}rv + 1e-6)",
             f"a{s}_{l}_trend_volz": f"({p}mom - {q}mom) * {q}volz", f"a{s}_{l}_ma": f"m{s} - m{l}", f"a{s}_{l}_stoch": f"{p}stoch - {q}stoch",
             f"a{s}_{l}_flow": f"{p}vol_flow - {q}vol_flow", f"a{s}_{l}_cci_rv": f"{p}cci * {q}rv"}
    return e, late


def _bank_b_full(s: int, l: int) -> dict[str, str]:
    """All operators of bank B for two windows."""
    safe = lambda a, b: f"({a}) / greatest(abs({b}), 1e-4)"
    rel = [f"rel_{x}" for x in features.REL_FEATURES]
    e = {f"b_{x}": x for x in ("ret_1", "oc_ret", "hl_range", "upper_shadow", "lower_shadow", "volume_change", "amount_change", "oi_change", "close_pos", *rel)}
    e |= {"b_ret_vol": "ret_1 * volume_change", "b_ret_amt": "ret_1 * amount_change", "b_ret_oi": "ret_1 * oi_change",
          "b_body_share": safe("abs(oc_ret)", "abs(hl_range) + abs(upper_shadow) + abs(lower_shadow) + 1e-3")}
    for w in (s, l):
        f, n = w_(w), f"b{w}_"
        avg = lambda x: f"avg({x}) OVER {f}"
        sd = lambda x: f"sqrt(greatest(var_pop({x}) OVER {f}, 1e-5))"
        root = lambda x: f"sqrt(greatest({avg(x)}, 1e-5))"
        corr = lambda x, y: safe(f"covar_pop({x}, {y}) OVER {f}", f"{sd(x)} * {sd(y)}")
        for x in features.Z_FEATURES:
            if x != "log1p_amount":
                e |= {f"{n}{x}_mean": avg(x), f"{n}{x}_std": sd(x), f"{n}{x}_mom": f"{x} - coalesce(lag({x}, {w - 1}) OVER {S}, 0)"}
        e |= {f"{n}{x}_z": safe(f"{x} - {avg(x)}", sd(x)) for x in ("ret_1", "oc_ret", "hl_range", "volume_change", "oi_change")}
        e |= {n + k: v for k, v in {
            "rv": root("ret_1 * ret_1"), "up_vol": root("greatest(ret_1, 0) ^ 2"), "down_vol": root("greatest(-ret_1, 0) ^ 2"), "abs_ret": avg("abs(ret_1)"),
            "ret_vol": avg("ret_1 * volume_change"), "ret_amt": avg("ret_1 * amount_change"), "ret_oi": avg("ret_1 * oi_change"),
            "corr_vol": corr("ret_1", "volume_change"), "corr_amt": corr("ret_1", "amount_change"), "corr_oi": corr("ret_1", "oi_change"),
            "vol_pressure": f"log1p_volume - {avg('log1p_volume')}", "amt_pressure": f"amount_change - {avg('amount_change')}", "oi_pressure": f"log1p_oi - {avg('log1p_oi')}",
            "stoch": avg("close_pos"), "bollinger": safe(f"close_pos - {avg('close_pos')}", sd("close_pos")), "mfi": avg("sign(ret_1) * log1p_volume"),
            "trend": safe(f"abs({avg('ret_1')})", root("ret_1 * ret_1")), "range_vol": corr("hl_range", "volume_change")}.items()}
    for x in ("ret_1", "oc_ret", "hl_range", "volume_change", "amount_change", "oi_change", "close_pos", "rel_ret_1"):
        e[f"b{s}_{l}_{x}"] = f"avg({x}) OVER {w_(s)} - avg({x}) OVER {w_(l)}"
    return e


BANK_A_IN = BANK_A + f""", ax AS (SELECT *, (close - open) / (sp + 1e-4) AS bop, high - greatest(open, close) AS up_sh, least(open, close) - low AS lo_sh,
    (high + low + close) / 3.0 AS typ, coalesce(lag(log_ret_1, 1) OVER {S}, 0) AS l1, coalesce(lag(log_ret_1, 2) OVER {S}, 0) AS l2 FROM ba)"""


def _register_bank_a(s: int, l: int) -> None:
    first, late = _bank_a_full(s, l)
    names = [n for n in (*first, *late) if not n.startswith("m")]
    sql = (f"WITH {BANK_A_IN}, a1 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in first.items())} FROM ax), a2 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in late.items())} FROM a1) "
           f"SELECT {KEY}, {', '.join(r(clip_sql(n, 12), n) for n in names)} FROM a2")

    @query(f"tf09_bank_a_{s}_{l}", sql)
    def _(t: Tables):
        bank, made = features.operator_bank_a(bank_frame(t, "bank_a"), (s, l), extra=True, rows=ROWS)
        assert sorted(made) == sorted(names)
        return out(bank, names)


def _register_bank_b(s: int, l: int) -> None:
    ops = _bank_b_full(s, l)

    @query(f"tf10_bank_b_{s}_{l}", f"WITH {BANK_B} SELECT {KEY}, {', '.join(r(clip_sql(e, 8), n) for n, e in ops.items())} FROM bb")
    def _(t: Tables):
        bank, made = features.operator_bank_b(bank_frame(t, "bank_b"), (s, l), ((s, l),), rows=ROWS)
        assert sorted(made) == sorted(ops)
        return out(bank, list(ops))


for _pair in features.BANK_A_PAIRS:
    _register_bank_a(*_pair)
for _pair in features.BANK_B_PAIRS:
    _register_bank_b(*_pair)


@query("tf12_window_summary", f"""WITH {STABLE} SELECT {KEY}, {', '.join(r(e, n) for n, e in (
   ('log_ret_1_last', 'log_ret_1'), ('log_ret_1_mean', f'avg(log_ret_1) OVER {w_(20)}'), ('log_ret_1_std', f'stddev_pop(log_ret_1) OVER {w_(20)}'),
   ('log_ret_1_min', f'min(log_ret_1) OVER {w_(20)}'), ('log_ret_1_max', f'max(log_ret_1) OVER {w_(20)}'), ('log_ret_1_chg', f'log_ret_1 - lag(log_ret_1, 19) OVER {S}')))}
   FROM stable QUALIFY bar_no >= 19""")
def _(t: Tables):
    d = features.stable_columns(t.d, "extended", rows=ROWS)[0]
    return out(features.window_summary(d, ("log_ret_1",), 20, ROWS), [f"log_ret_1_{n}" for n in ("last", "mean", "std", "min", "max", "chg")])


# ---- views ----------------------------------------------------------------------------------------------
@query("vw01_csz", f"WITH {BASE_D} SELECT {KEY}, {r(z_sql('close', 'datetime'), 'csz_close')}, {r(z_sql('volume', 'datetime'), 'csz_volume')} FROM base")
def _(t: Tables):
    return out(views.csz(t.d, t.g, ("close", "volume")), ("csz_close", "csz_volume"))


@query("vw01_csz_unbounded_groups", f"WITH {BASE_D} SELECT {KEY}, {r(z_sql('close', 'datetime'), 'csz_close')}, {r(pct_rank('volume', 'datetime') + ' - 0.5', 'csr_volume')} FROM base")
def _(t: Tables):
    # the path taken when no group size is known: partial aggregates and counts of distinct values
    from barwright.plans.xsec import Groups
    g = Groups(("datetime",))
    return out(views.csr(views.csz(t.d.select("symbol", "datetime", "close", "volume"), g, ("close",)), g, ("volume",)), ("csz_close", "csr_volume"))


@query("vw02_csr", f"WITH {BASE_D} SELECT {KEY}, {r(pct_rank('close', 'datetime') + ' - 0.5', 'csr_close')}, {r(pct_rank('oi', 'datetime') + ' - 0.5', 'csr_oi')} FROM base")
def _(t: Tables):
    return out(views.csr(t.d, t.g, ("close", "oi")), ("csr_close", "csr_oi"))


def tsz_sql(x: str, w: int = 60, m: int = 20) -> str:
    return f"CASE WHEN count({x}) OVER {w_(w)} >= {m} THEN ({x} - avg({x}) OVER {w_(w)}) / (stddev_samp({x}) OVER {w_(w)} + 1e-9) END"


@query("vw03_tsz", f"WITH {BASE_D} SELECT {KEY}, {r(tsz_sql('close'), 'tsz_close')}, {r(tsz_sql('logv'), 'tsz_logv')} FROM base")
def _(t: Tables):
    d = t.d.withColumn("logv", F.log1p("volume"))
    return out(views.tsz(d, ("close", "logv"), 60, 20, rows=ROWS), ("tsz_close", "tsz_logv"))


@query("vw04_selected_views", f"""WITH {BASE_D} SELECT {KEY}, {r(f'coalesce({clip_sql(tsz_sql("close"), 20.0)}, 0)', 'tsz_close')}, {r('coalesce(' + z_sql('loga', 'datetime') + ', 0)', 'csz_loga')},
   {r(pct_rank('close', 'datetime') + ' - 0.5', 'csr_close')}, {r('least(loga, 20.0)', 'loga')} FROM base""")
def _(t: Tables):
    d = t.d.withColumn("loga", F.log1p("amount"))
    names = ("tsz_close", "csz_loga", "csr_close", "loga")
    return out(views.selected_views(d, t.g, names, 20.0, 60, 20, ROWS), names)


@query("vw05_causal_z", f"WITH {FEAT} SELECT {KEY}, {r(rz_sql('ret_1'), 'rz_ret_1')}, {r(rz_sql('hl_range'), 'rz_hl_range')} FROM feat")
def _(t: Tables):
    return out(views.causal_z(features.base_features(t.d, ROWS), ("ret_1", "hl_range"), 40, 10, rows=ROWS), ("rz_ret_1", "rz_hl_range"))


@query("vw06_clip_only", f"WITH {FEAT} SELECT {KEY}, {r('coalesce(' + clip_sql('ret_1', 1.5) + ', 0)', 'cl_ret_1')} FROM feat")
def _(t: Tables):
    return out(views.clip_only(features.base_features(t.d, ROWS), ("ret_1",), 1.5), ("cl_ret_1",))


@query("vw07_relative", f"WITH {FEAT} SELECT {KEY}, {', '.join(r(_rel(x), f'rel_{x}') for x in features.REL_FEATURES)} FROM feat")
def _(t: Tables):
    return out(views.relative_features(features.base_features(t.d, ROWS), t.g, features.REL_FEATURES), [f"rel_{x}" for x in features.REL_FEATURES])


D_ = "OVER (PARTITION BY datetime)"


def _ctx(x: str) -> str:
    sd = f"coalesce(stddev_samp({x}) {D_}, 0)"
    return f"{r(f'avg({x}) {D_}', f'mkt_mean_{x}')}, {r(sd, f'mkt_std_{x}')}, {r(f'({x} - avg({x}) {D_}) / ({sd} + 1e-8)', f'rel_{x}')}"


@query("vw08_market_context", f"WITH {STABLE} SELECT {KEY}, {', '.join(_ctx(x) for x in ('log_ret_1', 'range_pct', 'd_log1p_volume'))} FROM stable")
def _(t: Tables):
    df, names = features.stable_columns(t.d, "extended_market_lite", t.g, ROWS)
    return out(df, [f"{p}_{x}" for x in ("log_ret_1", "range_pct", "d_log1p_volume") for p in ("mkt_mean", "mkt_std", "rel")])


@query("vw09_market_state", f"WITH {STABLE} SELECT {KEY}, {r(f'avg(range_pct) {D_}', 'state_mean_range_pct')}, {r(f'stddev_pop(range_pct) {D_}', 'state_std_range_pct')} FROM stable")
def _(t: Tables):
    return out(views.market_state(features.stable_columns(t.d, "extended", rows=ROWS)[0], t.g, ("range_pct",)), ("state_mean_range_pct", "state_std_range_pct"))


@query("vw10_pred_views", f"WITH {PREDS} SELECT {KEY}, {r(z_sql('p1', 'datetime', '1e-9'), 'p1_xsz')}, {r(pct_rank('p1', 'datetime') + ' - 0.5', 'p1_xrank')} FROM preds")
def _(t: Tables):
    return out(views.pred_views(t.preds, t.g, "p1"), ("p1_xsz", "p1_xrank"))


XV = PREDS + f""", x0 AS (SELECT *, {z_sql('p1', 'datetime', '1e-9')} AS z, p1 - avg(p1) {D_} AS xc, least(greatest({pct_rank('p1', 'datetime')}, 0.001), 0.999) AS pc,
   count(*) {D_} AS m FROM preds)"""


@query("vw11_extended_views", f"""WITH {XV} SELECT {KEY}, {r('xc', 'p1_xcenter')}, {r('z', 'p1_xsz')}, {r('pc - 0.5', 'p1_xrank')},
   {r(clip_sql(probit_sql('pc'), 3.1), 'p1_rankgauss')}, {r('asinh(z)', 'p1_asinh_z')}, {r('sign(z) * sqrt(abs(z))', 'p1_sqrt_signed_z')},
   {', '.join(r(clip_sql('z', b), f'p1_xsz_clip{b:g}'.replace('.', 'p')) for b in views.CLIPS)},
   {', '.join(r(f'tanh(z / {s})', f'p1_tanh_z_s{s:g}'.replace('.', 'p')) for s in views.TANH_SCALES)} FROM x0""")
def _(t: Tables):
    names = ["p1_xcenter", "p1_xsz", "p1_xrank", "p1_rankgauss", "p1_asinh_z", "p1_sqrt_signed_z"]
    names += [f"p1_xsz_clip{b:g}".replace(".", "p") for b in views.CLIPS] + [f"p1_tanh_z_s{s:g}".replace(".", "p") for s in views.TANH_SCALES]
    return out(views.extended_pred_views(t.preds, t.g, "p1"), names)


VARIANTS = PREDS + f""", v0 AS (SELECT *, p1 - avg(p1) OVER (PARTITION BY datetime, sector) AS sn FROM preds),
   v1 AS (SELECT *, CASE WHEN stddev_samp(p1) {D_} > 1e-12 THEN (p1 - avg(p1) {D_}) / (stddev_samp(p1) {D_} + 1e-8) END AS csz_p,
             CASE WHEN stddev_samp(sn) {D_} > 1e-12 THEN (sn - avg(sn) {D_}) / (stddev_samp(sn) {D_} + 1e-8) END AS snz FROM v0)"""


@query("vw12_pred_variants", f"WITH {VARIANTS} SELECT {KEY}, {r('csz_p', 'pred_cs_zscore')}, {r('sn', 'pred_sector_neutral')}, {r('snz', 'pred_sector_neutral_zscore')} FROM v1")
def _(t: Tables):
    return out(views.pred_variants(t.preds, t.g, "p1"), ("pred_cs_zscore", "pred_sector_neutral", "pred_sector_neutral_zscore"))


G_ = "OVER (PARTITION BY datetime, grp)"


@query("vw13_group_context", f"WITH {LADDER} SELECT {KEY}, {r(f'avg(ret1) {G_}', 'grp_ret1_mean')}, {r(f'ret1 - avg(ret1) {G_}', 'rel_ret1_grp')}, {r(f'avg(ret1) {D_}', 'market_ret1_mean')} FROM ladder")
def _(t: Tables):
    return out(views.group_context(ladder(t), t.g, ("ret1",)), ("grp_ret1_mean", "rel_ret1_grp", "market_ret1_mean"))


C_ = "OVER (PARTITION BY datetime, chain)"
PEER = f"coalesce((sum(ret1) {C_} - ret1) / nullif(count(ret1) {C_} - 1, 0), avg(ret1) {G_})"


@query("vw14_chain_peers", f"WITH {LADDER} SELECT {KEY}, {r(PEER, 'chain_peer_ret1')}, {r(f'ret1 - {PEER}', 'rel_ret1_chain')} FROM ladder")
def _(t: Tables):
    return out(views.chain_peers(ladder(t), t.g, ("ret1",)), ("chain_peer_ret1", "rel_ret1_chain"))


@query("vw15_lagged_context", f"""WITH {LADDER}, y AS (SELECT *, avg(ret1) {G_} AS gm, {PEER} AS pm FROM ladder) SELECT {KEY},
   {', '.join(r(f'coalesce(lag({a}, {k}) OVER {S}, 0)', f'{n}_lag{k}') for a, n in (('gm', 'grp_ret1_mean'), ('pm', 'chain_peer_ret1')) for k in (1, 3))} FROM y""")
def _(t: Tables):
    d = views.chain_peers(ladder(t), t.g, ("ret1",))
    return out(views.lagged_context(d, ("grp_ret1_mean", "chain_peer_ret1"), rows=ROWS), [f"{n}_lag{k}" for n in ("grp_ret1_mean", "chain_peer_ret1") for k in (1, 3)])


@query("vw16_group_pivot", f"""WITH {LADDER}, p AS (SELECT datetime, {', '.join(f"coalesce(avg(ret1) FILTER (WHERE grp = '{v}'), 0) AS chain_ret_{v}" for v in ('g0', 'g1', 'g2', 'other'))}
   FROM ladder GROUP BY datetime) SELECT {KEY}, {rs([f'chain_ret_{v}' for v in ('g0', 'g1', 'g2', 'other')])} FROM ladder JOIN p USING (datetime)""")
def _(t: Tables):
    return out(views.group_return_pivot(ladder(t), "ret1", ("g0", "g1", "g2", "other")), [f"chain_ret_{v}" for v in ("g0", "g1", "g2", "other")])


@query("vw17_calendar_encoding", f"""WITH {PANEL_H} SELECT {KEY}, {i('dense_rank() OVER (ORDER BY symbol) - 1', 'symbol_code')},
   {', '.join(r(f'{f}(2 * pi() * {x} / {p})', f'{n}_{f}', 6) for f in ('sin', 'cos') for n, x, p in (('minute', '(hour(datetime) * 60 + minute(datetime))', '1440.0'), ('dow', '(isodow(datetime) - 1)', '7.0'), ('month', 'month(datetime)', '12.0')))},
   {r('least(session_pos / 240.0, 4.0)', 'session_pos_scaled', 6)} FROM panel""")
def _(t: Tables):
    return out(views.calendar_encoding(t.h).withColumn("session_pos_scaled", F.round("session_pos_scaled", 6)),
               ("symbol_code", "minute_sin", "minute_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "session_pos_scaled"), digits=6)


EV = f"coalesce(least(abs({z_sql('ret1', 'datetime', '1e-9')}), 8), 0) + coalesce(least(abs({z_sql('range_rel', 'datetime', '1e-9')}), 8), 0) + 0.65 * coalesce(least(abs({z_sql('log_amount', 'datetime', '1e-9')}), 8), 0) + 0.35 * coalesce(least(abs({z_sql('oi_chg', 'datetime', '1e-9')}), 8), 0)"


@query("vw18_event_score", f"WITH {LADDER} SELECT {KEY}, {r(EV, 'event_score')} FROM ladder")
def _(t: Tables):
    d = views.event_score(ladder(t), t.g, {"ret1": 1.0, "range_rel": 1.0, "log_amount": 0.65, "oi_chg": 0.35})
    return out(d, ("event_score",))


@query("vw19_shapes", f"""WITH {PREDS}, q AS (SELECT quantile_cont(p1, 0.02) AS lo, quantile_cont(p1, 0.98) AS hi, quantile_cont(abs(p1), 0.9) AS sc FROM preds WHERE {TRAIN})
   SELECT {KEY}, {r('sign(p1) * abs(p1) ^ 0.8', 's_power')}, {r('sign(least(greatest(p1, lo), hi)) * abs(least(greatest(p1, lo), hi)) ^ 0.8', 's_winsor')},
   {r('p1 / (1 + abs(p1) / sc)', 's_softsign')}, {r('asinh(p1 / sc)', 's_asinh')} FROM preds, q""")
def _(t: Tables):
    return out(views.shape_transforms(t.preds, "p1", train_rows()), ("s_power", "s_winsor", "s_softsign", "s_asinh"))


NQ = 101
PROBS = "[" + ", ".join(repr(0.001 + 0.998 * k / (NQ - 1)) for k in range(NQ)) + "]"


@query("vw20_rank_gauss", f"""WITH {PREDS}, q AS (SELECT quantile_cont(p1, {PROBS}) AS e FROM preds WHERE {TRAIN}),
   y AS (SELECT *, (0.001 + {0.998 / (NQ - 1)!r} * least(len(list_filter(e, lambda v: v < p1)), {NQ - 1}))::DOUBLE AS p FROM preds, q)
   SELECT {KEY}, {r(probit_sql('p'), 'p1_rg')} FROM y""")
def _(t: Tables):
    return out(views.rank_gauss(t.preds, "p1", train_rows(), NQ), ("p1_rg",))


@query("vw21_feature_xsz", f"""WITH {PREDS} SELECT {KEY}, {', '.join(r(z_sql(x, 'datetime', '1e-9'), f'xsz_{x}') for x in ('p1', 'p2', 'p3'))} FROM preds""")
def _(t: Tables):
    return out(views.csz(t.preds, t.g, ("p1", "p2", "p3"), 1e-9, "xsz_"), ("xsz_p1", "xsz_p2", "xsz_p3"))


@query("vw22_postprocess", f"""WITH {PREDS} SELECT {KEY}, {r(f'p1 - avg(p1) {D_}', 'dm')}, {r(f'coalesce((p1 - avg(p1) {D_}) / nullif(stddev_samp(p1) {D_}, 0), 0)', 'tz')},
   {r('p1 - avg(p1) OVER (PARTITION BY symbol)', 'sd')} FROM preds""")
def _(t: Tables):
    d = t.preds.select("symbol", "datetime", F.col("p1").alias("dm"), F.col("p1").alias("tz"), F.col("p1").alias("sd"))
    for mode, x in (("datetime_demean", "dm"), ("datetime_zscore", "tz"), ("symbol_demean", "sd")):
        d = views.postprocess(d, t.g, mode, x)
    return out(d, ("dm", "tz", "sd"))


@query("vw23_rescale", f"""WITH {PREDS}, s AS (SELECT avg(p1) AS mx, stddev_pop(p1) AS sx, avg(p3) AS mr, stddev_pop(p3) AS sr FROM preds WHERE {TRAIN})
   SELECT {KEY}, {r('(p1 - mx) / greatest(sx, 1e-8) * greatest(sr, 1e-8) + mr', 'scaled')} FROM preds, s""")
def _(t: Tables):
    return out(views.rescale_to_reference(t.preds, "p1", "p3", train_rows(), "scaled"), ("scaled",))
