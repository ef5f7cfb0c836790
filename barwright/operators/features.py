"""Second feature vocabulary: base features, lite operators, session-scoped blocks, operator banks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.expr import clip, finite, ln_pos
from barwright.plans import chunks, xsec
from barwright.plans.rolling import Rolling
from barwright.plans.xsec import Groups

c_ = F.col
E8 = 1e-8
# Column sets and window lists of the vocabulary.
Z_FEATURES = ("ret_1", "oc_ret", "hl_range", "upper_shadow", "lower_shadow", "log1p_volume", "volume_change",
              "log1p_amount", "amount_change", "log1p_oi", "oi_change")
REL_FEATURES = ("ret_1", "oc_ret", "hl_range", "volume_change", "amount_change", "oi_change")
BANK_B_WINDOWS = (3, 5, 8, 13, 21, 34, 55, 89)
BANK_B_PAIRS = ((3, 13), (5, 21), (8, 34), (13, 55), (21, 89))
BANK_A_PAIRS = ((3, 13), (5, 21), (8, 34), (10, 42), (13, 55), (16, 72), (21, 89))
EXTENDED = ("log_ret_1", "range_pct", "close_pos", "oc_ret", "d_log1p_volume", "d_log1p_amount", "d_log1p_oi")
RAW = ("open", "high", "low", "close", "log1p_volume", "log1p_amount", "log1p_oi")


def _floor(x: str) -> Column:
    return F.greatest(c_(x), F.lit(E8))


def _base(r: Rolling) -> Rolling:
    spread = F.when(c_("high") != c_("low"), _floor("high") - _floor("low"))
    r.define(log1p_volume=F.log1p(F.greatest(c_("volume"), F.lit(0.0))),
             log1p_amount=F.log1p(F.greatest(c_("amount"), F.lit(0.0))),
             log1p_oi=F.log1p(F.greatest(c_("oi"), F.lit(0.0))), _lc=F.ln(_floor("close")))
    r.define(_plc=r.lag("_lc"), _pv=r.lag("log1p_volume"), _pa=r.lag("log1p_amount"), _po=r.lag("log1p_oi"))
    kept = ~c_("is_long_break_before")
    return r.define(
        ret_1=F.when(kept, c_("_lc") - c_("_plc")), oc_ret=F.ln(_floor("close") / _floor("open")),
        hl_range=F.ln(_floor("high") / _floor("low")),
        close_pos=clip((_floor("close") - _floor("low")) / (spread + F.lit(E8)), 0.0, 1.0),
        upper_shadow=clip((_floor("high") - F.greatest(_floor("open"), _floor("close"))) / (spread + F.lit(E8)), 0.0, 1e300),
        lower_shadow=clip((F.least(_floor("open"), _floor("close")) - _floor("low")) / (spread + F.lit(E8)), 0.0, 1e300),
        volume_change=F.when(kept, c_("log1p_volume") - c_("_pv")),
        amount_change=F.when(kept, c_("log1p_amount") - c_("_pa")),
        oi_change=F.when(kept, c_("log1p_oi") - c_("_po")))


def base_features(df: DataFrame, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Return, range, shadow, activity level and change columns; NULL across a break."""
    return _base(Rolling(df, 1, 0, rows)).close().drop("_lc", "_plc", "_pv", "_pa", "_po")


def rolling_mean_sum(df: DataFrame, x: str, window: int, min_periods: int, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    r = Rolling(df, window + 1, 0, rows)
    n, s = r.count(x, window), r.sum(x, window)
    ok = n >= min_periods
    return r.emit(**{f"{x}_sum_{window}": F.when(ok, s), f"{x}_mean_{window}": F.when(ok, F.try_divide(s, n))}).close()


def lite_operators(df: DataFrame, windows: Sequence[int] = (5, 20, 60), rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Return z, momentum, mean absolute return, volume z and return-volume co-movement per window."""
    r = _base(Rolling(df, 2 * max(windows) + 2, 0, rows))
    r.define(_abs=F.abs("ret_1"))
    first: dict[str, Column] = {}
    for w in windows:
        m = max(3, w // 3)
        n, mean, var = r.stats("ret_1", w)
        nv, vmean, vvar = r.stats("volume_change", w)
        ok, okv = n >= m, nv >= m
        sd, vsd = F.sqrt(F.greatest(var, F.lit(1e-12))), F.sqrt(F.greatest(vvar, F.lit(1e-12)))
        first |= {
            f"op_ret_zscore_{w}": F.when(ok, clip((c_("ret_1") - mean) / (sd + F.lit(E8)), -12, 12)),
            f"op_momentum_{w}": c_("_lc") - r.prev("_lc", w),
            f"op_abs_ret_mean_{w}": F.when(r.count("_abs", w) >= m, F.try_divide(r.sum("_abs", w), r.count("_abs", w))),
            f"op_volume_zscore_{w}": F.when(okv, clip((c_("volume_change") - vmean) / (vsd + F.lit(E8)), -12, 12)),
            f"_co_{w}": F.when(ok & okv, (c_("ret_1") - mean) * (c_("volume_change") - vmean)),
            f"_ss_{w}": F.when(ok & okv, sd * vsd)}
    r.emit_all(first)
    second = {}
    for w in windows:
        m, x = max(3, w // 3), f"_co_{w}"
        cov = F.when(r.count(x, w) >= m, F.try_divide(r.sum(x, w), r.count(x, w)))
        second[f"op_ret_volume_corr_{w}"] = clip(cov / (c_(f"_ss_{w}") + F.lit(E8)), -1, 1)
    r.emit_all(second)
    helpers = [c for c in r.df.columns if c.startswith("_") and c not in ("_chunk", "_own")]
    r.df = r.df.drop(*helpers)
    return r.close()


def build_features(df: DataFrame, g: Groups, windows: Sequence[int] = (5, 20), rows: int = chunks.CHUNK_ROWS
                   ) -> tuple[DataFrame, list[str], list[str]]:
    """Full build: base and lite columns, then cross-sectional relatives; returns z and clip columns."""
    from barwright.operators.views import relative_features
    out = relative_features(lite_operators(df, windows, rows), g, REL_FEATURES)
    ops = [c for c in out.columns if c.startswith("op_")]
    return out, [*Z_FEATURES, *ops], ["close_pos", *[f"rel_{c}" for c in REL_FEATURES]]


# ---- session-scoped block ---------------------------------------------------------------------
def _stable(r: Rolling) -> Rolling:
    lvl = lambda x: F.log1p(F.greatest(F.coalesce(c_(x), F.lit(0.0)), F.lit(0.0)))
    r.define(log1p_volume=lvl("volume"), log1p_amount=lvl("amount"), log1p_oi=lvl("oi"), _lc=F.ln(_floor("close")))
    diff = lambda x: F.coalesce(c_(x) - r.lag(x), F.lit(0.0))
    return r.define(
        log_ret_1=diff("_lc"), range_pct=(c_("high") - c_("low")) / (F.abs(_floor("close")) + F.lit(E8)),
        close_pos=(_floor("close") - c_("low")) / (c_("high") - c_("low") + F.lit(E8)) - F.lit(0.5),
        oc_ret=_floor("close") / _floor("open") - 1, d_log1p_volume=diff("log1p_volume"),
        d_log1p_amount=diff("log1p_amount"), d_log1p_oi=diff("log1p_oi"))


def stable_columns(df: DataFrame, feature_set: str = "base", g: Groups | None = None,
                   rows: int = chunks.CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """Raw column sets base / extended / extended_market / extended_market_lite / ohlcv_factors."""
    if feature_set == "ohlcv_factors":
        return ohlcv_block(df, g, rows=rows)
    out = _stable(Rolling(df, 1, 0, rows, session=True)).close().drop("_lc")
    names = list(RAW)
    if feature_set != "base":
        names += EXTENDED
    if feature_set in ("extended_market", "extended_market_lite"):
        from barwright.operators.views import market_context
        ctx = EXTENDED if feature_set == "extended_market" else ("log_ret_1", "range_pct", "d_log1p_volume")
        out = market_context(out, g, ctx)
        names += [f"{p}_{c}" for c in ctx for p in ("mkt_mean", "mkt_std", "rel")]
    return out.withColumns({n: F.coalesce(finite(n), F.lit(0.0)) for n in names}), names


def prior_z(r: Rolling, x: str, w: int, min_periods: int, bound: float, eps: float = E8) -> Column:
    """z against the ``w`` bars before the current one, population deviation, 0 when too few."""
    n, m, var = r.stats(x, w, 1)
    z = clip((c_(x) - m) / (F.sqrt(var) + F.lit(eps)), -bound, bound)
    return F.when(n >= min_periods, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0))


def group_prior_z(df: DataFrame, cols: Sequence[str], window: int, min_periods: int, bound: float = 20.0,
                  session: bool = True, prefix: str = "pz_", rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    r = Rolling(df, window + 2, 0, rows, session=session)
    return r.emit_all({f"{prefix}{c}": prior_z(r, c, window, min_periods, bound) for c in cols}).close()


def ohlcv_block(df: DataFrame, g: Groups, windows: Sequence[int] = (5, 15, 30), surprise: Sequence[int] = (30, 120),
                steps: Sequence[int] = (2, 5, 15, 30), rows: int = chunks.CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """Bar shape, momentum, volatility, prior-only surprises, interactions, lags, relatives."""
    r = _stable(Rolling(df, 2 * max(*surprise, *windows) + 8, 0, rows, session=True))
    spread, body = F.greatest(c_("high") - c_("low"), F.lit(E8)), _floor("close") - _floor("open")
    mid = F.lit(0.5) * (c_("high") + c_("low"))
    shape = {"hl_log_range": F.ln(_floor("high") / _floor("low")), "body_pct": body / spread,
             "upper_wick_pct": (c_("high") - F.greatest(_floor("open"), _floor("close"))) / spread,
             "lower_wick_pct": (F.least(_floor("open"), _floor("close")) - c_("low")) / spread,
             "close_to_mid": (_floor("close") - mid) / spread, "body_to_close": body / F.abs(_floor("close"))}
    r.define(**shape, _sq=c_("log_ret_1") * c_("log_ret_1"))
    first: dict[str, Column] = {}
    for k in steps:
        first[f"log_ret_{k}"] = F.coalesce(c_("_lc") - r.prev("_lc", k), F.lit(0.0))
    for w in windows:
        enough = r.count("_sq", w) >= max(3, w // 3)
        first[f"rv_{w}"] = F.when(enough, F.sqrt(F.greatest(r.sum("_sq", w) / r.count("_sq", w), F.lit(0.0)))).otherwise(0.0)
        first[f"range_mean_{w}"] = F.when(enough, r.sum("range_pct", w) / r.count("range_pct", w)).otherwise(0.0)
    for b in ("log1p_volume", "log1p_amount", "log1p_oi"):
        for w in surprise:
            first[f"{b}_surprise_{w}"] = prior_z(r, b, w, max(10, w // 4), 20.0)
    r.emit_all(first)
    s0 = f"log1p_volume_surprise_{surprise[0]}"
    inter = {"ret_x_range": c_("log_ret_1") * c_("range_pct"), "ret_x_close_pos": c_("log_ret_1") * c_("close_pos"),
             "close_pos_x_range": c_("close_pos") * c_("range_pct"), "ret_x_volume_surprise": c_("log_ret_1") * c_(s0),
             "body_x_volume_surprise": c_("body_pct") * c_(s0), "ret_x_oi_change": c_("log_ret_1") * c_("d_log1p_oi"),
             "absret_per_amount": F.abs("log_ret_1") / (F.lit(1.0) + F.abs("log1p_amount"))}
    lags = {f"{b}_lag{k}": F.coalesce(r.prev(b, k), F.lit(0.0)) for b, ks in (
        ("log_ret_1", (1, 2, 5)), ("range_pct", (1,)), ("close_pos", (1,)), ("d_log1p_volume", (1,)), (s0, (1,)))
        for k in ks}
    r.emit_all({**inter, **lags})
    out = r.close().drop("_lc", "_sq")
    top = f"rv_{max(windows)}"
    ctx = ("log_ret_1", "range_pct", "d_log1p_volume", top, s0)
    aggs = {}
    for x in ctx:
        aggs[f"_m_{x}"], aggs[f"_s_{x}"] = F.avg(x), F.stddev_samp(x)
    out = xsec.with_stats(out, g, aggs)
    rel = {f"xrel_{x}": F.coalesce((c_(x) - c_(f"_m_{x}")) / (F.when(c_(f"_s_{x}") > 0, c_(f"_s_{x}")) + F.lit(E8)), F.lit(0.0))
           for x in ctx}
    out = out.withColumns(rel).drop(*aggs)
    for x in ctx:
        out = xsec.with_rank(out, g, x, pct=f"xrank_{x}")
    out = out.withColumns({f"xrank_{x}": F.coalesce(c_(f"xrank_{x}") - F.lit(0.5), F.lit(0.0)) for x in ctx})
    names = [*RAW, *EXTENDED, *shape, *first, *inter, *lags, *rel, *[f"xrank_{x}" for x in ctx]]
    return out, names


def return_ladder(df: DataFrame, steps: Sequence[int] = (3, 6, 12, 24, 48), rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Log returns over several steps per symbol, bar body and range, activity levels, oi change."""
    r = Rolling(df, max(steps) + 1, 0, rows)
    tiny = lambda x: F.greatest(c_(x), F.lit(1e-12))
    r.define(_loi=F.log1p(F.greatest(c_("oi"), F.lit(0.0))))
    br = c_("is_long_break_before")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    past = lambda k: F.when(r.prev("close", k).isNotNull(), F.greatest(r.prev("close", k), F.lit(1e-12)))
    cols = {"ret1": F.when(br, 0.0).otherwise(zero(F.ln(tiny("close") / past(1)))),
            "intrabar_ret": F.ln(tiny("close") / tiny("open")), "range_rel": (c_("high") - c_("low")) / tiny("close"),
            "body_rel": (tiny("close") - tiny("open")) / tiny("open"),
            "log_volume": F.log1p(F.greatest(c_("volume"), F.lit(0.0))), "log_amount": F.log1p(F.greatest(c_("amount"), F.lit(0.0))),
            "oi_chg": F.when(br, 0.0).otherwise(zero(c_("_loi") - r.prev("_loi", 1)))}
    for k in steps:
        cols[f"ret{k}"] = zero(F.ln(tiny("close") / past(k)))
    return r.emit_all(cols).close().drop("_loi")


# ---- operator banks -----------------------------------------------------------------------------
def _partial(r: Rolling, x: str, w: int) -> Column:
    """Mean over the bars present: fewer than ``w`` at the start of a symbol."""
    return F.try_divide(r.sum(x, w), r.count(x, w))


def operator_bank_a(df: DataFrame, windows: Sequence[int], extra: bool = False, bound: float = 12.0,
                    rows: int = chunks.CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """13 + 33 per window + 4 per window pair operators (extra: + 6, + 20, + 4) on the 14 extended columns."""
    ins = (*RAW, *EXTENDED)
    r = Rolling(df.withColumns({c: F.coalesce(c_(c), F.lit(0.0)) for c in ins}), 2 * max(windows) + 8, 0, rows)
    ret, vol, amt, oi, close = (c_(x) for x in ("log_ret_1", "log1p_volume", "log1p_amount", "log1p_oi", "close"))
    spread, tanh4 = F.greatest(c_("high") - c_("low"), F.lit(1e-4)), F.tanh(ret * F.lit(4.0))
    r.define(a_body=close - c_("open"), a_upper=c_("high") - F.greatest("open", "close"),
             a_lower=F.least("open", "close") - c_("low"), a_turn=amt - vol, a_typ=(c_("high") + c_("low") + close) / F.lit(3.0))
    r.define(a_bop=c_("a_body") / (spread + F.lit(1e-4)), _sh=c_("a_lower") - c_("a_upper"), _sv=tanh4 * vol, _sa=tanh4 * amt,
             _abs=F.abs(ret), _pos=F.greatest(ret, F.lit(0.0)), _neg=F.greatest(-ret, F.lit(0.0)), _sq=ret * ret,
             _sig=F.lit(1.0) / (F.lit(1.0) + F.exp(ret * F.lit(-8.0))), _ra=F.abs("range_pct"), _r2=c_("range_pct") * c_("range_pct"),
             _va=F.abs(vol), _sgv=F.signum(ret) * F.abs(vol), _il=F.abs(ret) / (F.abs(amt) + F.lit(1.0)),
             _bp=F.abs("a_body") * (c_("close_pos") - F.lit(0.5)))
    r.define(_pos2=c_("_pos") * c_("_pos"), _neg2=c_("_neg") * c_("_neg"), _pv=c_("_pos") * vol, _av=c_("_abs") * c_("_va"),
             _l1=F.coalesce(r.lag("log_ret_1", 1), F.lit(0.0)), _l2=F.coalesce(r.lag("log_ret_1", 2), F.lit(0.0)))
    z0 = lambda x, k: F.coalesce(r.prev(x, k), F.lit(0.0))
    ops = {"a_body": c_("a_body"), "a_bop": c_("a_bop"), "a_upper": c_("a_upper"), "a_lower": c_("a_lower"), "a_turn": c_("a_turn"),
           "a_ret_range": ret * c_("range_pct"), "a_ret_cpos": ret * c_("close_pos"), "a_ret_dvol": ret * c_("d_log1p_volume"),
           "a_ret_doi": ret * c_("d_log1p_oi"), "a_range_dvol": c_("range_pct") * c_("d_log1p_volume"), "a_oc_vol": c_("oc_ret") * vol,
           "a_ret_lag1": z0("log_ret_1", 1), "a_cpos_lag1": z0("close_pos", 1)}
    if extra:
        ops |= {"a_typ": c_("a_typ"), "a_abs_ret": c_("_abs"), "a_ret_sq": c_("_sq"), "a_dir_range": F.signum(ret) * c_("_ra"),
                "a_dvol_doi": c_("d_log1p_volume") - c_("d_log1p_oi"), "a_turn_dir": c_("a_turn") * tanh4}
    tiny = F.lit(1e-6)

    def sd(x: str, w: int) -> Column:
        return F.sqrt(r.stats(x, w)[2] + tiny)

    def corr(x: str, y: str, w: int) -> Column:
        return r.covariance(x, y, w) / (sd(x, w) * sd(y, w) + tiny)

    def zed(x: str, w: int) -> Column:
        return (c_(x) - _partial(r, x, w)) / (sd(x, w) + tiny)

    later: dict[str, Column] = {}
    for w in windows:
        root = lambda x: F.sqrt(F.greatest(_partial(r, x, w), F.lit(0.0)) + tiny)
        n = lambda s: f"a{w}_{s}"
        hi, lo = r.max("high", w), r.min("low", w)
        mom, rv, up, dn = r.sum("log_ret_1", w), root("_sq"), root("_pos2"), root("_neg2")
        stoch, volz, oimom = (close - lo) / (hi - lo + F.lit(1e-4)), zed("log1p_volume", w), r.sum("d_log1p_oi", w)
        ops |= {n("mom"): mom, n("sharpe"): _partial(r, "log_ret_1", w) / (sd("log_ret_1", w) + tiny), n("upratio"): _partial(r, "_sig", w),
                n("maxret"): r.max("log_ret_1", w), n("minret"): r.min("log_ret_1", w), n("rv"): rv, n("up"): up, n("down"): dn,
                n("volskew"): (up - dn) / (up + dn + tiny), n("volz"): volz, n("amtz"): zed("log1p_amount", w), n("oiz"): zed("log1p_oi", w),
                n("oimom"): oimom, n("stoch"): stoch, n("willr"): F.lit(1.0) - stoch, n("bollz"): zed("close", w), n("drawup"): close - lo,
                n("drawdn"): close - hi, n("eff"): F.abs(mom) / (r.sum("_abs", w) + tiny), n("pvcorr"): corr("log_ret_1", "log1p_volume", w),
                n("pacorr"): corr("log_ret_1", "log1p_amount", w), n("oicorr"): corr("log_ret_1", "d_log1p_oi", w), n("bop"): _partial(r, "a_bop", w),
                n("cpos"): _partial(r, "close_pos", w), n("shadow"): _partial(r, "_sh", w), n("vol_flow"): r.sum("_sv", w),
                n("amt_flow"): r.sum("_sa", w), n("tr_dir"): F.signum(mom) * _partial(r, "_ra", w), n("mom_volz"): mom * volz,
                n("mom_oimom"): mom * oimom, n("rv_volz"): rv * volz, n("mfi"): r.sum("_pv", w) / (r.sum("_av", w) + tiny)}
        ops[f"_ma{w}"], ops[f"_cci{w}"], ops[f"_st{w}"] = _partial(r, "close", w), zed("a_typ", w), stoch
        if extra:
            thrust = F.greatest(hi - r.min("close", w), r.max("close", w) - lo)
            ops |= {n("px_ma"): close - _partial(r, "close", w), n("roc"): close - z0("close", w), n("range_rms"): root("_r2"),
                    n("range_mean"): _partial(r, "_ra", w), n("cci"): zed("a_typ", w),
                    n("cmo"): (r.sum("_pos", w) - r.sum("_neg", w)) / (r.sum("_abs", w) + tiny), n("ac1"): corr("log_ret_1", "_l1", w),
                    n("ac2"): corr("log_ret_1", "_l2", w), n("volmom"): vol - z0("log1p_volume", w), n("amtmom"): amt - z0("log1p_amount", w),
                    n("turnz"): zed("a_turn", w), n("illiq"): _partial(r, "_il", w), n("updn_vol"): r.sum("_sgv", w) / (r.sum("_va", w) + tiny),
                    n("oi_dir"): oimom * F.signum(mom), n("shadow_sd"): sd("a_lower", w) - sd("a_upper", w), n("body_pos"): _partial(r, "_bp", w),
                    n("thrust"): (close - (lo + F.lit(0.5) * thrust)) / (F.abs(thrust) + tiny)}
    r.emit_all(ops)
    for w in windows:
        later[f"a{w}_stoch_dev"] = c_(f"_st{w}") - _partial(r, f"_st{w}", min(5, w))
        if extra:
            later |= {f"a{w}_{x}_lag1": z0(f"a{w}_{x}", 1) for x in ("mom", "rv", "volz")}
    for s, l in [(a, b) for a, b in BANK_A_PAIRS if a in windows and b in windows]:
        trend = c_(f"a{s}_mom") - c_(f"a{l}_mom")
        later |= {f"a{s}_{l}_trend": trend, f"a{s}_{l}_volz": c_(f"a{s}_volz") - c_(f"a{l}_volz"),
                  f"a{s}_{l}_rv": c_(f"a{s}_rv") / (c_(f"a{l}_rv") + tiny), f"a{s}_{l}_trend_volz": trend * c_(f"a{l}_volz")}
        if extra:
            later |= {f"a{s}_{l}_ma": c_(f"_ma{s}") - c_(f"_ma{l}"), f"a{s}_{l}_stoch": c_(f"a{s}_stoch") - c_(f"a{l}_stoch"),
                      f"a{s}_{l}_flow": c_(f"a{s}_vol_flow") - c_(f"a{l}_vol_flow"), f"a{s}_{l}_cci_rv": c_(f"_cci{s}") * c_(f"a{l}_rv")}
    r.emit_all(later)
    names = [x for x in (*ops, *later) if not x.startswith("_")]
    return r.close().select("symbol", "datetime", *[clip(x, -bound, bound).alias(x) for x in names]), names


def operator_bank_b(df: DataFrame, windows: Sequence[int] = BANK_B_WINDOWS, pairs: Sequence[tuple[int, int]] = BANK_B_PAIRS,
                    bound: float = 8.0, rows: int = chunks.CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """19 base, 53 per window and 8 per window pair operators on normalised base and relative features."""
    ins = (*Z_FEATURES, "close_pos", *[f"rel_{x}" for x in REL_FEATURES])
    r = Rolling(df.withColumns({c: F.coalesce(c_(c), F.lit(0.0)) for c in ins}), 2 * max(max(windows), *[b for _, b in pairs], 2) + 4, 0, rows)
    ret, vc, ac, oc = (c_(x) for x in ("ret_1", "volume_change", "amount_change", "oi_change"))
    r.define(_rr=ret * ret, _up=F.pow(F.greatest(ret, F.lit(0.0)), F.lit(2.0)), _dn=F.pow(F.greatest(-ret, F.lit(0.0)), F.lit(2.0)),
             _abs=F.abs(ret), _rv=ret * vc, _ra=ret * ac, _ro=ret * oc, _sv=F.signum(ret) * c_("log1p_volume"))
    safe = lambda a, b: a / F.greatest(F.abs(b), F.lit(1e-4))
    plain = ("ret_1", "oc_ret", "hl_range", "upper_shadow", "lower_shadow", "volume_change", "amount_change", "oi_change", "close_pos",
             *[f"rel_{x}" for x in REL_FEATURES])
    ops = {f"b_{x}": c_(x) for x in plain}
    ops |= {"b_ret_vol": c_("_rv"), "b_ret_amt": c_("_ra"), "b_ret_oi": c_("_ro"),
            "b_body_share": safe(F.abs("oc_ret"), F.abs("hl_range") + F.abs("upper_shadow") + F.abs("lower_shadow") + F.lit(1e-3))}
    sd = lambda x, w: F.sqrt(F.greatest(r.stats(x, w)[2], F.lit(1e-5)))
    corr = lambda x, y, w: safe(r.covariance(x, y, w), sd(x, w) * sd(y, w))
    mean = lambda x, w: _partial(r, x, w)
    for w in windows:
        n = lambda s: f"b{w}_{s}"
        for x in Z_FEATURES:
            if x == "log1p_amount":
                continue
            back = F.coalesce(r.prev(x, w - 1), F.lit(0.0)) if w > 1 else c_(x)
            ops |= {n(f"{x}_mean"): mean(x, w), n(f"{x}_std"): sd(x, w), n(f"{x}_mom"): c_(x) - back}
        for x in ("ret_1", "oc_ret", "hl_range", "volume_change", "oi_change"):
            ops[n(f"{x}_z")] = safe(c_(x) - mean(x, w), sd(x, w))
        root = lambda x: F.sqrt(F.greatest(mean(x, w), F.lit(1e-5)))
        ops |= {n("rv"): root("_rr"), n("up_vol"): root("_up"), n("down_vol"): root("_dn"), n("abs_ret"): mean("_abs", w), n("ret_vol"): mean("_rv", w),
                n("ret_amt"): mean("_ra", w), n("ret_oi"): mean("_ro", w), n("corr_vol"): corr("ret_1", "volume_change", w),
                n("corr_amt"): corr("ret_1", "amount_change", w), n("corr_oi"): corr("ret_1", "oi_change", w),
                n("vol_pressure"): c_("log1p_volume") - mean("log1p_volume", w), n("amt_pressure"): ac - mean("amount_change", w),
                n("oi_pressure"): c_("log1p_oi") - mean("log1p_oi", w), n("stoch"): mean("close_pos", w),
                n("bollinger"): safe(c_("close_pos") - mean("close_pos", w), sd("close_pos", w)), n("mfi"): mean("_sv", w),
                n("trend"): safe(F.abs(mean("ret_1", w)), root("_rr")), n("range_vol"): corr("hl_range", "volume_change", w)}
    for s, l in pairs:
        for x in ("ret_1", "oc_ret", "hl_range", "volume_change", "amount_change", "oi_change", "close_pos", "rel_ret_1"):
            ops[f"b{s}_{l}_{x}"] = mean(x, s) - mean(x, l)
    r.emit_all(ops)
    return r.close().select("symbol", "datetime", *[clip(F.coalesce(c_(x), F.lit(0.0)), -bound, bound).alias(x) for x in ops]), list(ops)


def top_operators(scores: DataFrame, group: Sequence[str], score: str, k: int, name: str = "factor") -> DataFrame:
    """The k operators per group with the largest absolute score (a score table has one row an operator)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy(F.abs(score).desc(), F.col(name))
    return scores.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def window_summary(df: DataFrame, cols: Sequence[str], length: int, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Last, mean, population deviation, minimum, maximum and last - first over the last L bars."""
    r = Rolling(df, length + 1, 0, rows)
    out: dict[str, Column] = {"_full": F.col("bar_no") >= length - 1}
    for x in cols:
        n, m, var = r.stats(x, length)
        out |= {f"{x}_last": c_(x), f"{x}_mean": m, f"{x}_std": F.sqrt(var), f"{x}_min": r.min(x, length),
                f"{x}_max": r.max(x, length), f"{x}_chg": c_(x) - r.prev(x, length - 1)}
    return r.emit_all(out).close().where("_full").drop("_full")
