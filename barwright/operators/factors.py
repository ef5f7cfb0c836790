"""Causal rolling factors per symbol, masked where the lookback reaches over a long break.

Each family takes an open ``Rolling`` frame holding the base series and returns factor columns.
``factor_panel`` plans any choice of families together: one shuffle, one sort, staged projections.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.expr import adjusted_kurt, adjusted_skew
from barwright.operators.sessions import bars_since_break
from barwright.plans import chunks
from barwright.plans.rolling import Rolling, ewm_bars

# The window lists and pairs of the factor vocabulary.
WINS = (2, 3, 4, 5, 6, 8, 10, 13, 16, 21, 26, 34, 42, 55, 72, 89, 120, 144, 180, 233, 288)
WINS_MID = (4, 6, 8, 10, 13, 16, 21, 26, 34, 42, 55, 72, 89, 120, 144, 180, 233)
EMA_PAIRS = ((3, 13), (5, 21), (8, 34), (10, 42), (13, 55), (16, 72), (21, 89), (5, 55), (13, 144), (21, 180))
SHAPE_WINS = (8, 21, 55)
LAG_BASES = ("mom_13", "mom_34", "rv_21", "volz_21", "stoch_21", "rsi_21", "bollz_21", "cci_21", "mfi_21",
             "pvcorr_34", "bop_21", "cpos")
LAGS = (1, 2, 3, 5)

E9 = 1e-9
Cols = dict[str, Column]
c_ = F.col


def masked(x: Column, lookback: int) -> Column:
    """NULL where the lookback would reach over a long break (the counter is a base series here)."""
    return F.when(c_("_bss") >= lookback, x)


def _eps(x: Column) -> Column:
    return x + F.lit(E9)


def _abs_close() -> Column:
    return _eps(F.abs("close"))


def base_series(r: Rolling) -> Rolling:
    """Log return (0 at a break), log volume/amount/oi, true range, up and down moves, bar shape."""
    fill = lambda x: F.coalesce(c_(x), F.lit(0.0))
    r.define(_bss=bars_since_break(), volume=fill("volume"), amount=fill("amount"), oi=fill("oi"),
             typ=(c_("high") + c_("low") + c_("close")) / F.lit(3.0),
             hl=F.greatest(c_("high") - c_("low"), F.lit(E9)))
    r.define(_pc=r.lag("close"), _pt=r.lag("typ"), _poi=r.lag("oi"))
    ratio = F.when((c_("_pc").isNotNull()) & (c_("close") > 0) & ~c_("is_long_break_before"),
                   F.ln(c_("close") / F.greatest(c_("_pc"), F.lit(E9))))
    oi_floor = lambda x: F.greatest(c_(x), F.lit(1.0))
    doi = F.when(c_("_poi").isNotNull() & ~c_("is_long_break_before"), F.ln(oi_floor("oi") / oi_floor("_poi")))
    move = c_("close") - c_("_pc")
    tr = F.when(c_("_pc").isNotNull(), F.greatest(
        c_("high") - c_("low"), F.abs(c_("high") - c_("_pc")), F.abs(c_("low") - c_("_pc"))))
    r.define(lr=F.coalesce(ratio, F.lit(0.0)), dloi=F.coalesce(doi, F.lit(0.0)),
             logv=F.log1p(F.greatest(c_("volume"), F.lit(0.0))), loga=F.log1p(F.greatest(c_("amount"), F.lit(0.0))),
             logoi=F.log1p(oi_floor("oi")),
             up=F.when(move > 0, move).otherwise(0.0), dn=F.when(move < 0, -move).otherwise(0.0),
             tr=F.coalesce(tr, F.lit(0.0)),
             flow_up=F.when(c_("typ") > c_("_pt"), c_("typ") * c_("volume")).otherwise(0.0),
             flow_dn=F.when(c_("typ") < c_("_pt"), c_("typ") * c_("volume")).otherwise(0.0),
             bop=(c_("close") - c_("open")) / c_("hl"), body=F.abs(c_("close") - c_("open")) / c_("hl"),
             upsh=(c_("high") - F.greatest("open", "close")) / c_("hl"),
             losh=(F.least("open", "close") - c_("low")) / c_("hl"), cpos=(c_("close") - c_("low")) / c_("hl"))
    gained, lost = c_("lr") > 0, c_("lr") < 0
    return r.define(
        lr_up=gained.cast("double"), lr_abs=F.abs("lr"), lr_sq=c_("lr") * c_("lr"),
        lr_sq_dn=F.when(lost, c_("lr") * c_("lr")).otherwise(0.0),
        lr_sq_up=F.when(gained, c_("lr") * c_("lr")).otherwise(0.0),
        log_hl_sq=F.pow(F.ln(F.greatest(c_("high"), F.lit(E9)) / F.greatest(c_("low"), F.lit(E9))), F.lit(2.0)),
        rel_range=(c_("high") - c_("low")) / _abs_close(),
        turn=c_("loga") - c_("logv"), illiq=F.abs("lr") / (c_("loga") + F.lit(1e-6)),
        sgn_vol=F.signum("lr") * c_("logv"), sgn_amt=F.signum("lr") * c_("loga"),
        vol_up=F.when(gained, c_("logv")).otherwise(0.0), vol_dn=F.when(lost, c_("logv")).otherwise(0.0),
        vwap=F.when(c_("volume") > 0, c_("amount") / F.greatest(c_("volume"), F.lit(E9))).otherwise(c_("close")),
        body_pos=c_("body") * (c_("cpos") - F.lit(0.5)))


BASE = ("typ", "hl", "_pc", "_pt", "_poi", "lr", "dloi", "logv", "loga", "logoi", "up", "dn", "tr", "flow_up",
        "flow_dn", "lr_up", "lr_abs", "lr_sq", "lr_sq_dn", "lr_sq_up", "log_hl_sq", "rel_range", "turn", "illiq",
        "sgn_vol", "sgn_amt", "vol_up", "vol_dn", "vwap", "body_pos")


# ---- momentum ---------------------------------------------------------------------------------
def mom(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"mom_{w}": masked(r.sum("lr", w), w) for w in ws}


def sharpe(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"sharpe_{w}": masked(r.mean("lr", w) / _eps(r.std("lr", w)), w) for w in ws}


def upratio(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"upratio_{w}": masked(r.mean("lr_up", w), w) for w in ws}


def extremes(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"{n}_{w}": masked(f("lr", w), w) for w in ws for n, f in (("maxret", r.max), ("minret", r.min))}


def px_sma(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"px_sma_{w}": masked(c_("close") / _eps(r.mean("close", w)) - 1, w) for w in ws}


def roc(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"roc_{w}": masked(F.try_divide(c_("close"), r.prev("close", w)) - 1, w) for w in ws}


def accel(r: Rolling, ws: Sequence[int] = ()) -> Cols:
    return {"mom_accel": masked(r.sum("lr", 8) - r.sum("lr", 34), 34),
            "oi_accel": masked(r.sum("dloi", 8) - r.sum("dloi", 34), 34)}


def ema_diff(r: Rolling, pairs: Sequence[tuple[int, int]]) -> Cols:
    """Difference of two exponential averages of the close; they run across sessions."""
    return {f"ema_diff_{a}_{b}": masked((r.ewm("close", a) - r.ewm("close", b)) / _abs_close(), b) for a, b in pairs}


def macd(r: Rolling, pairs: Sequence[tuple[int, int]]) -> Cols:
    return {f"_ed_{a}_{b}": r.ewm("close", a) - r.ewm("close", b) for a, b in pairs}


def vwap_macd(r: Rolling, pairs: Sequence[tuple[int, int]]) -> Cols:
    return {f"vwap_macd_{a}_{b}": masked((r.ewm("vwap", a) - r.ewm("vwap", b)) / _abs_close(), b) for a, b in pairs}


# ---- volatility -------------------------------------------------------------------------------
def rv(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"rv_{w}": masked(F.sqrt(F.greatest(r.sum("lr_sq", w), F.lit(0.0))), w) for w in ws}


def park(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"park_{w}": masked(F.sqrt(F.greatest(r.sum("log_hl_sq", w), F.lit(0.0)) / (F.lit(4.0 * w) * F.ln(F.lit(2.0)))), w)
            for w in ws}


def downside(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        # running sums of squares never fall, and a frame of zeros differs by exactly zero
        dn = F.sqrt(F.greatest(r.sum("lr_sq_dn", w), F.lit(0.0)))
        up = F.sqrt(F.greatest(r.sum("lr_sq_up", w), F.lit(0.0)))
        out[f"dvol_{w}"] = masked(dn, w)
        out[f"volskew_{w}"] = masked((up - dn) / _eps(up + dn), w)
    return out


def shape(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        n, s = F.lit(float(w)), r.power_sums("lr", w)
        out[f"skew_{w}"] = masked(adjusted_skew(n, *s[:3]), w)
        out[f"kurt_{w}"] = masked(adjusted_kurt(n, *s), w)
    return out


def atr(r: Rolling, ws: Sequence[int]) -> Cols:
    return {k: v for w in ws for k, v in (
        (f"atr_{w}", masked(r.mean("tr", w) / _abs_close(), w)),
        (f"range_{w}", masked(r.mean("rel_range", w), w)))}


def vol_regime(r: Rolling, ws: Sequence[int] = ()) -> Cols:
    root = lambda w: F.sqrt(F.greatest(r.sum("lr_sq", w), F.lit(0.0)))
    return {"vol_regime": masked(root(8) / _eps(root(55)), 55)}


# ---- oscillators ------------------------------------------------------------------------------
def stoch(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        lo, hi = r.min("low", w), r.max("high", w)
        full = r.count("close", w) >= w
        out[f"_stoch_{w}"] = F.when(full, (c_("close") - lo) / _eps(hi - lo))
        out[f"stoch_{w}"] = masked((c_("close") - lo) / _eps(hi - lo), w)
        out[f"willr_{w}"] = masked((hi - c_("close")) / _eps(hi - lo), w)
    return out


def stoch_dev(r: Rolling, ws: Sequence[int]) -> Cols:
    """Second stage on the raw stochastic: minus its 5-bar mean (at least 3 values)."""
    out: Cols = {}
    for w in ws:
        x = f"_stoch_{w}"
        m = F.when(r.count(x, 5) >= 3, F.try_divide(r.sum(x, 5), r.count(x, 5)))
        out[f"stoch_dev_{w}"] = masked(c_(x) - m, w)
    return out


def rsi(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"rsi_{w}": masked(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + r.mean("up", w) / _eps(
        F.greatest(r.mean("dn", w), F.lit(0.0)))), w) for w in ws}


def cci(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"cci_{w}": masked((c_("typ") - r.mean("typ", w)) / _eps(F.lit(0.015 * 0.8) * r.std("typ", w)), w)
            for w in ws}


def bollz(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"bollz_{w}": masked((c_("close") - r.mean("close", w)) / _eps(r.std("close", w)), w) for w in ws}


def cmo(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"cmo_{w}": masked((r.sum("up", w) - r.sum("dn", w)) / _eps(r.sum("up", w) + r.sum("dn", w)), w)
            for w in ws}


def autocorr(r: Rolling, ws: Sequence[int]) -> Cols:
    r.define(_lr1=r.lag("lr", 1), _lr2=r.lag("lr", 2))
    return {f"ret_ac{k}_{w}": masked(r.corr("lr", f"_lr{k}", w), w) for w in ws for k in (1, 2)}


# ---- volume, amount, open interest ------------------------------------------------------------
def _z(r: Rolling, x: str, w: int) -> Column:
    sd = r.std(x, w)
    return F.when(sd > 0, (c_(x) - r.mean(x, w)) / _eps(sd)).otherwise(0.0)


def activity_z(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"{n}_{w}": masked(_z(r, x, w), w) for w in ws
            for n, x in (("volz", "logv"), ("amtz", "loga"), ("turnover_z", "turn"))}


def volz(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"volz_{w}": masked(_z(r, "logv", w), w) for w in ws}


def activity_mom(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"{n}_{w}": masked(c_(x) - r.prev(x, w), w) for w in ws
            for n, x in (("volmom", "logv"), ("amtmom", "loga"))}


def activity_corr(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"{n}_{w}": masked(r.corr("lr", x, w), w) for w in ws
            for n, x in (("pvcorr", "logv"), ("pacorr", "loga"), ("ret_oi_corr", "dloi"))}


def illiq(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"illiq_{w}": masked(r.mean("illiq", w), w) for w in ws}


def flows(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"{n}_{w}": masked(r.sum(x, w), w) for w in ws
            for n, x in (("vol_flow", "sgn_vol"), ("amt_flow", "sgn_amt"))}


def updn_vol(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"updn_vol_ratio_{w}": masked((r.sum("vol_up", w) - r.sum("vol_dn", w))
                                          / _eps(r.sum("vol_up", w) + r.sum("vol_dn", w)), w) for w in ws}


def amount_share(r: Rolling, ws: Sequence[int]) -> Cols:
    out = {f"amt_prop_signed_{w}": masked(F.signum("lr") * c_("amount") / _eps(r.sum("amount", w)), w) for w in ws}
    full = r.count("amount", 12) >= 12
    out["amt_share_signed"] = F.when(full, F.signum("lr") * c_("amount") / _eps(r.sum("amount", 12))).otherwise(0.0)
    return out


def mfi(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        lost = F.greatest(r.sum("flow_dn", w), F.lit(0.0))
        out[f"mfi_{w}"] = masked(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + r.sum("flow_up", w) / _eps(lost)), w)
    return out


def vwap_dev(r: Rolling, ws: Sequence[int]) -> Cols:
    out = {"vwap_dev": (c_("close") - c_("vwap")) / _abs_close()}
    for w in ws:
        out[f"vwap_dev_{w}"] = masked((c_("close") - r.sum("amount", w) / _eps(r.sum("volume", w))) / _abs_close(), w)
    return out


def open_interest(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {"oi_chg": c_("dloi"), "oi_vol_ratio": c_("logoi") - c_("logv")}
    for w in ws:
        # a sum of log changes can cancel exactly; keep its sign clean of rounding
        out[f"oimom_{w}"] = masked(r.sum("dloi", w), w)
        out[f"oiz_{w}"] = masked(_z(r, "logoi", w), w)
        out[f"oipx_div_{w}"] = masked(r.sum("dloi", w) * F.signum(r.sum("lr", w)), w)
    return out


# ---- geometry, interactions, efficiency -------------------------------------------------------
def geometry(r: Rolling, ws: Sequence[int] = SHAPE_WINS) -> Cols:
    names = ("bop", "body", "upsh", "losh", "cpos")
    return {f"{n}_{w}": masked(r.mean(n, w), w) for n in names for w in ws}


def shadows(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        out[f"shadow_imb_{w}"] = masked(r.mean("losh", w) - r.mean("upsh", w), w)
        out[f"shadow_vol_diff_{w}"] = masked(r.std("losh", w) - r.std("upsh", w), w)
        out[f"body_pos_inter_{w}"] = masked(r.mean("body_pos", w), w)
    return out


def dual_thrust(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        hh, ll, hc, lc = r.max("high", w), r.min("low", w), r.max("close", w), r.min("close", w)
        span = F.greatest(hh - lc, hc - ll)
        out[f"dual_thrust_pos_{w}"] = masked((c_("close") - (ll + F.lit(0.5) * span)) / _eps(span), w)
    return out


def tr_dir(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"tr_dir_{w}": masked(F.signum(r.sum("lr", w)) * r.mean("tr", w) / _abs_close(), w) for w in ws}


def interactions(r: Rolling, ws: Sequence[int]) -> Cols:
    out: Cols = {}
    for w in ws:
        m, z = r.sum("lr", w), _z(r, "logv", w)
        out[f"mom_x_volz_{w}"] = masked(m * z, w)
        out[f"mom_x_oimom_{w}"] = masked(m * r.sum("dloi", w), w)
        out[f"rv_x_volz_{w}"] = masked(F.sqrt(F.greatest(r.sum("lr_sq", w), F.lit(0.0))) * z, w)
    return out


def efficiency(r: Rolling, ws: Sequence[int]) -> Cols:
    return {f"effratio_{w}": masked(F.abs(r.sum("lr", w)) / _eps(r.sum("lr_abs", w)), w) for w in ws}


def drawdown(r: Rolling, ws: Sequence[int]) -> Cols:
    return {k: v for w in ws for k, v in (
        (f"drawdn_{w}", masked(c_("close") / _eps(r.max("close", w)) - 1, w)),
        (f"drawup_{w}", masked(c_("close") / _eps(r.min("close", w)) - 1, w)))}


FAMILIES: dict[str, tuple[Callable[[Rolling, Sequence], Cols], Sequence]] = {
    "mom": (mom, WINS), "sharpe": (sharpe, WINS), "upratio": (upratio, WINS), "extremes": (extremes, WINS),
    "px_sma": (px_sma, WINS_MID), "roc": (roc, WINS_MID), "accel": (accel, (34,)), "rv": (rv, WINS),
    "park": (park, WINS), "downside": (downside, WINS_MID), "shape": (shape, WINS_MID), "atr": (atr, WINS_MID),
    "vol_regime": (vol_regime, (55,)), "stoch": (stoch, WINS_MID), "rsi": (rsi, WINS_MID), "cci": (cci, WINS_MID),
    "bollz": (bollz, WINS_MID), "cmo": (cmo, WINS_MID), "autocorr": (autocorr, WINS_MID),
    "activity_z": (activity_z, WINS_MID), "activity_mom": (activity_mom, WINS_MID),
    "activity_corr": (activity_corr, WINS_MID), "illiq": (illiq, WINS_MID), "flows": (flows, WINS_MID),
    "updn_vol": (updn_vol, WINS_MID), "amount_share": (amount_share, WINS_MID), "mfi": (mfi, WINS_MID),
    "vwap_dev": (vwap_dev, WINS_MID), "open_interest": (open_interest, WINS_MID), "geometry": (geometry, SHAPE_WINS),
    "shadows": (shadows, WINS_MID), "dual_thrust": (dual_thrust, WINS_MID), "tr_dir": (tr_dir, WINS_MID),
    "interactions": (interactions, WINS_MID), "efficiency": (efficiency, WINS_MID), "drawdown": (drawdown, WINS_MID),
    "ema_diff": (ema_diff, EMA_PAIRS), "macd": (macd, EMA_PAIRS), "vwap_macd": (vwap_macd, EMA_PAIRS),
}
EWM_FAMILIES = ("ema_diff", "macd", "vwap_macd")
STAGE_COLUMNS = 120


def factor_panel(panel: DataFrame, families: Sequence[str] | None = None,
                 windows: Sequence[int] | None = None, pairs: Sequence[tuple[int, int]] | None = None,
                 lag_bases: Sequence[str] = (), lags: Sequence[int] = LAGS, geometry_raw: bool = False,
                 keep: Sequence[str] = ("symbol", "datetime"), rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Wide factor frame for the chosen families; all of them by default.

    ``panel`` needs bars and session columns. Families are evaluated in groups of bounded width, so
    generated code stays within compiler limits, all on the same chunked and sorted frame.
    """
    chosen = list(families or FAMILIES)
    spec: list[tuple[str, Sequence]] = []
    for name in chosen:
        fn, default = FAMILIES[name]
        if name in EWM_FAMILIES:
            spec.append((name, tuple(pairs or default)))
        else:
            spec.append((name, tuple(windows) if windows and name not in ("accel", "vol_regime") else default))
    longest = max([60] + [max(w) for n, w in spec if n not in EWM_FAMILIES and w])
    before = 2 * longest + 16
    for n, p in spec:
        if n in EWM_FAMILIES:
            before = max(before, ewm_bars(max(b for _, b in p)) + 2)
    held = [c for c in dict.fromkeys([*keep, "symbol", "bar_no", "session_id", "session_pos", "open", "high", "low",
                                      "close", "volume", "amount", "oi", "is_long_break_before"])]
    r = base_series(Rolling(panel.select(*held), before, 0, rows))
    made: list[str] = []
    batch: Cols = {}

    def flush() -> None:
        nonlocal batch
        if batch:
            r.emit_all(batch)
            made.extend(n for n in batch if not n.startswith("_"))
            batch = {}

    for name, args in spec:
        fn = FAMILIES[name][0]
        cols = fn(r, args)
        batch.update(cols)
        if name == "stoch":
            flush()
            batch.update(stoch_dev(r, args))
        elif name == "macd":
            flush()
            # change of the difference, a second stage over the averages
            batch.update({f"macd_{a}_{b}": masked((c_(f"_ed_{a}_{b}") - r.prev(f"_ed_{a}_{b}")) / _abs_close(), b)
                          for a, b in args})
        if len(batch) >= STAGE_COLUMNS:
            flush()
    flush()
    if geometry_raw:
        made += ["bop", "body", "upsh", "losh", "cpos"]
    lagged: Cols = {}
    for base in lag_bases:
        for k in lags:
            lagged[f"{base}_lag{k}"] = masked(r.prev(base, k), k)
    if lagged:
        r.emit_all(lagged)
        made.extend(lagged)
    return r.close().select(*keep, *made)



GROUP_WINDOWS = 60
LAG_FAMILIES = ("mom", "rv", "activity_z", "stoch", "rsi", "bollz", "cci", "mfi", "activity_corr", "geometry")
RAW_GEOMETRY = ("bop", "body", "upsh", "losh", "cpos")


def factor_groups(panel: DataFrame, keep: Sequence[str] = ("symbol", "datetime"), rows: int = chunks.CHUNK_ROWS) -> Iterator[DataFrame]:
    """The whole vocabulary (1,034 columns) as frames of ``keep`` and some families each.

    One frame of all columns costs the planner far more than the sum of its parts, since every stage carries the columns before it. Each
    frame copies into its pieces only the bars that its own windows need, so the long exponential averages do not burden the rest.
    """
    group: list[str] = []
    for name in FAMILIES:
        alone = name in EWM_FAMILIES
        if group and (alone or sum(len(FAMILIES[n][1]) for n in (*group, name)) > GROUP_WINDOWS):
            yield factor_panel(panel, group, keep=keep, rows=rows)
            group = []
        group.append(name)
    yield factor_panel(panel, group, keep=keep, rows=rows)
    lagged = factor_panel(panel, LAG_FAMILIES, (13, 21, 34), lag_bases=LAG_BASES, geometry_raw=True, keep=keep, rows=rows)
    yield lagged.select(*keep, *RAW_GEOMETRY, *[f"{b}_lag{k}" for b in LAG_BASES for k in LAGS])
