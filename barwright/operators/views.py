"""Normalisation views: cross-sectional, time-series, causal, grouped, calendar and shape views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.expr import clip, edges_below, finite, minute_of_day, probit
from barwright.plans import chunks, xsec
from barwright.plans.ordinal import with_codes
from barwright.plans.rolling import Rolling
from barwright.plans.xsec import Groups
from barwright.plans.xsec import scalars

c_ = F.col
PREFIXES = ("tsz_", "csz_", "csr_")
CLIPS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0)
TANH_SCALES = (0.75, 1.0, 1.5, 2.0, 3.0)


def csz(df: DataFrame, g: Groups, cols: Sequence[str], eps: float | None = 1e-8, prefix: str = "csz_",
        bound: float | None = None) -> DataFrame:
    """z over the group; ``eps=None`` turns a zero spread into NULL."""
    aggs: dict[str, Column] = {}
    for x in cols:
        aggs[f"_m_{x}"], aggs[f"_s_{x}"] = F.avg(x), F.stddev_samp(x)
    out = xsec.with_stats(df, g, aggs)

    def z(x: str) -> Column:
        s = c_(f"_s_{x}")
        v = F.try_divide(c_(x) - c_(f"_m_{x}"), F.when(s > 0, s)) if eps is None else (c_(x) - c_(f"_m_{x}")) / (s + F.lit(eps))
        return clip(v, -bound, bound) if bound else v

    return out.withColumns({prefix + x: z(x) for x in cols}).drop(*aggs)


def csr(df: DataFrame, g: Groups, cols: Sequence[str], prefix: str = "csr_") -> DataFrame:
    """Average-tie rank share minus one half."""
    for x in cols:
        df = xsec.with_rank(df, g, x, pct=prefix + x)
    return df.withColumns({prefix + x: c_(prefix + x) - F.lit(0.5) for x in cols})


def csr_unit(df: DataFrame, g: Groups, x: str, out: str) -> DataFrame:
    """(rank - 1) / (count - 1) - 1/2, zero for a single member."""
    df = xsec.with_rank(df, g, x, rank="_r", count="_n")
    v = F.try_divide(c_("_r") - F.lit(1.0), c_("_n") - F.lit(1.0)) - F.lit(0.5)
    return df.withColumn(out, F.coalesce(v, F.lit(0.0))).drop("_r", "_n")


def tsz(df: DataFrame, cols: Sequence[str], window: int = 120, min_periods: int = 30, eps: float = 1e-9,
        prefix: str = "tsz_", rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """z over the symbol's trailing bars, current bar included, sample deviation."""
    r = Rolling(df, window + 1, 0, rows)
    out = {}
    for x in cols:
        n, m, var = r.stats(x, window)
        sd = F.sqrt(var * F.try_divide(n, n - F.lit(1.0)))
        out[prefix + x] = F.when(n >= min_periods, (c_(x) - m) / (sd + F.lit(eps)))
    return r.emit_all(out).close()


def selected_views(df: DataFrame, g: Groups, names: Sequence[str], bound: float = 20.0, window: int = 120,
                   min_periods: int = 30, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Materialise exactly the named views (``tsz_``/``csz_``/``csr_`` prefix or raw), NULL to 0, clipped."""
    want = {p: [n[len(p):] for n in names if n.startswith(p)] for p in PREFIXES}
    if want["tsz_"]:
        df = tsz(df, want["tsz_"], window, min_periods, rows=rows)
    if want["csz_"]:
        df = csz(df, g, want["csz_"])
    if want["csr_"]:
        df = csr(df, g, want["csr_"])
    return df.select("symbol", "datetime", *[bounded(n, bound).alias(n) for n in names])


def bounded(n: str, bound: float = 20.0) -> Column:
    """A column as models read it: what is missing or not finite is 0, the rest clipped."""
    return clip(F.coalesce(finite(n), F.lit(0.0)), -bound, bound)


def causal_z(df: DataFrame, cols: Sequence[str], window: int = 240, min_periods: int = 60, bound: float = 8.0,
             prefix: str = "rz_", session: bool = False, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Strictly causal z: statistics of the bars before the current one only."""
    r = Rolling(df, window + 2, 0, rows, session=session)
    out = {}
    for x in cols:
        n, m, var = r.stats(x, window, 1)
        sd = F.sqrt(F.greatest(var, F.lit(1e-12)))
        z = clip((c_(x) - m) / (sd + F.lit(1e-8)), -bound, bound)
        out[prefix + x] = F.when(n >= min_periods, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0))
    return r.emit_all(out).close()


def clip_only(df: DataFrame, cols: Sequence[str], bound: float = 8.0, prefix: str = "cl_") -> DataFrame:
    return df.withColumns({prefix + x: clip(F.coalesce(finite(x), F.lit(0.0)), -bound, bound) for x in cols})


def relative_features(df: DataFrame, g: Groups, cols: Sequence[str], bound: float = 8.0) -> DataFrame:
    """Cross-sectional z, clipped, NULL where the spread is zero."""
    aggs: dict[str, Column] = {}
    for x in cols:
        aggs[f"_m_{x}"], aggs[f"_s_{x}"] = F.avg(x), F.stddev_samp(x)
    out = xsec.with_stats(df, g, aggs)
    s = lambda x: F.when(c_(f"_s_{x}") > 0, c_(f"_s_{x}"))
    return out.withColumns({f"rel_{x}": clip((c_(x) - c_(f"_m_{x}")) / (s(x) + F.lit(1e-8)), -bound, bound)
                            for x in cols}).drop(*aggs)


def market_context(df: DataFrame, g: Groups, cols: Sequence[str]) -> DataFrame:
    """Per-timestamp mean and deviation as columns, and the value relative to them."""
    aggs: dict[str, Column] = {}
    for x in cols:
        aggs[f"mkt_mean_{x}"], aggs[f"_s_{x}"] = F.avg(x), F.stddev_samp(x)
    out = xsec.with_stats(df, g, aggs)
    made = {}
    for x in cols:
        sd = F.when(c_(f"_s_{x}") > 0, c_(f"_s_{x}")).otherwise(0.0)
        made[f"mkt_std_{x}"] = sd
        made[f"rel_{x}"] = F.coalesce((c_(x) - c_(f"mkt_mean_{x}")) / (sd + F.lit(1e-8)), F.lit(0.0))
    return out.withColumns(made).drop(*[f"_s_{x}" for x in cols])


def market_state(df: DataFrame, g: Groups, cols: Sequence[str]) -> DataFrame:
    aggs: dict[str, Column] = {}
    for x in cols:
        aggs[f"state_mean_{x}"], aggs[f"state_std_{x}"] = F.avg(x), F.stddev_pop(x)
    return xsec.with_stats(df, g, aggs)


def pred_views(df: DataFrame, g: Groups, x: str = "pred", eps: float = 1e-9) -> DataFrame:
    df = csz(df, g, [x], eps, "_z_").withColumnRenamed(f"_z_{x}", f"{x}_xsz")
    return csr(df, g, [x], "_r_").withColumnRenamed(f"_r_{x}", f"{x}_xrank")


def extended_pred_views(df: DataFrame, g: Groups, x: str = "pred") -> DataFrame:
    """Centred, z, rank, rank-Gaussian, asinh, signed root, nine clips and five tanh scales."""
    df = xsec.with_stats(df, g, {"_m": F.avg(x), "_s": F.stddev_samp(x)})
    df = xsec.with_rank(df, g, x, pct="_p")
    df = df.withColumns({"_zz": (c_(x) - c_("_m")) / (c_("_s") + F.lit(1e-9)), "_pc": clip("_p", 0.001, 0.999)})
    z = c_("_zz")
    out = {f"{x}_xcenter": c_(x) - c_("_m"), f"{x}_xsz": z, f"{x}_xrank": c_("_pc") - F.lit(0.5),
           f"{x}_rankgauss": clip(probit("_pc"), -3.1, 3.1), f"{x}_asinh_z": F.asinh(z),
           f"{x}_sqrt_signed_z": F.signum(z) * F.sqrt(F.abs(z))}
    out |= {f"{x}_xsz_clip{b:g}".replace(".", "p"): clip(z, -b, b) for b in CLIPS}
    out |= {f"{x}_tanh_z_s{s:g}".replace(".", "p"): F.tanh(z / F.lit(s)) for s in TANH_SCALES}
    return df.withColumns(out).drop("_m", "_s", "_p", "_zz", "_pc")


def pred_variants(df: DataFrame, g: Groups, x: str = "pred") -> DataFrame:
    """Cross-sectional z, sector-neutral value and its z."""
    aggs = {"_sec": F.avg(x)}
    df = xsec.with_stats(df, g.within("sector"), aggs).withColumn("pred_sector_neutral", c_(x) - c_("_sec")).drop("_sec")
    aggs = {}
    for v in (x, "pred_sector_neutral"):
        aggs[f"_m_{v}"], aggs[f"_s_{v}"] = F.avg(v), F.stddev_samp(v)
    df = xsec.with_stats(df, g, aggs)

    def z(v: str) -> Column:
        # a spread that is only rounding counts as zero
        return (c_(v) - c_(f"_m_{v}")) / (F.when(c_(f"_s_{v}") > 1e-12, c_(f"_s_{v}")) + F.lit(1e-8))

    return df.withColumns({"pred_cs_zscore": z(x), "pred_sector_neutral_zscore": z("pred_sector_neutral")}).drop(*aggs)


def group_context(df: DataFrame, g: Groups, cols: Sequence[str], group: str = "grp") -> DataFrame:
    df = xsec.with_stats(df, g.within(group), {f"grp_{x}_mean": F.avg(x) for x in cols})
    df = xsec.with_stats(df, g, {f"market_{x}_mean": F.avg(x) for x in cols})
    return df.withColumns({f"rel_{x}_grp": c_(x) - c_(f"grp_{x}_mean") for x in cols})


def chain_peers(df: DataFrame, g: Groups, cols: Sequence[str], group: str = "grp", chain: str = "chain") -> DataFrame:
    """Mean of the other members of the chain, the group mean where the symbol is alone."""
    df = xsec.with_stats(df, g.within(group), {f"grp_{x}_mean": F.avg(x) for x in cols})
    aggs: dict[str, Column] = {}
    for x in cols:
        aggs[f"_s_{x}"], aggs[f"_n_{x}"] = F.sum(x), F.count(x)
    df = xsec.with_stats(df, g.within(chain), aggs)
    df = df.withColumns({f"chain_peer_{x}": F.coalesce(
        F.try_divide(c_(f"_s_{x}") - c_(x), (c_(f"_n_{x}") - 1).cast("double")), c_(f"grp_{x}_mean")) for x in cols})
    return df.withColumns({f"rel_{x}_chain": c_(x) - c_(f"chain_peer_{x}") for x in cols}).drop(*aggs)


def lagged_context(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 3), rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    r = Rolling(df, max(lags) + 1, 0, rows)
    return r.emit_all({f"{x}_lag{k}": F.coalesce(r.prev(x, k), F.lit(0.0)) for x in cols for k in lags}).close()


def group_return_pivot(df: DataFrame, x: str, groups: Sequence[str], group: str = "grp") -> DataFrame:
    """Group means as columns per timestamp, joined back; the pivot values are given, so no extra pass."""
    wide = df.groupBy("datetime").pivot(group, list(groups)).agg(F.avg(x))
    wide = wide.select("datetime", *[F.coalesce(c_(v), F.lit(0.0)).alias(f"chain_ret_{v}") for v in groups])
    return df.join(wide, "datetime", "left")


def calendar_encoding(df: DataFrame) -> DataFrame:
    tau = F.lit(2.0) * F.pi()
    m, d, mo = minute_of_day("datetime"), F.weekday("datetime"), F.month("datetime")
    return with_codes(df, "symbol", "symbol_code").withColumns({
        "minute_sin": F.sin(tau * m / F.lit(1440.0)), "minute_cos": F.cos(tau * m / F.lit(1440.0)),
        "dow_sin": F.sin(tau * d / F.lit(7.0)), "dow_cos": F.cos(tau * d / F.lit(7.0)),
        "month_sin": F.sin(tau * mo / F.lit(12.0)), "month_cos": F.cos(tau * mo / F.lit(12.0)),
        "session_pos_scaled": F.least(c_("session_pos") / F.lit(240.0), F.lit(4.0))})


def event_score(df: DataFrame, g: Groups, weights: dict[str, float], bound: float = 8.0) -> DataFrame:
    """Weighted sum of clipped absolute cross-sectional z values."""
    df = csz(df, g, list(weights), 1e-9, "_e_")
    score = F.lit(0.0)
    for x, w in weights.items():
        score = score + F.lit(w) * F.coalesce(clip(F.abs(f"_e_{x}"), 0.0, bound), F.lit(0.0))
    return df.withColumn("event_score", score).drop(*[f"_e_{x}" for x in weights])


def shape_transforms(df: DataFrame, x: str, train: Column, gamma: float = 0.8, q: float = 0.02, scale_q: float = 0.9) -> DataFrame:
    """Power, winsorised power, softsign and asinh with quantiles of the train rows."""
    src = df.where(train)
    lo, hi = xsec.edges(src, x, [q, 1 - q]) or (float("-inf"), float("inf"))
    scale = F.lit(max([*xsec.edges(src, F.abs(x), [scale_q]), 1e-12]))
    power = lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(gamma))
    return df.withColumns({
        "s_power": power(c_(x)), "s_winsor": power(clip(x, lo, hi)),
        "s_softsign": c_(x) / (F.lit(1.0) + F.abs(x) / scale), "s_asinh": F.asinh(c_(x) / scale)})


def rank_gauss(df: DataFrame, x: str, train: Column, n: int = 1001) -> DataFrame:
    """Feature to normal scores through train quantiles (left-sided search, capped)."""
    lo, hi = 0.001, 0.999
    probs = [lo + (hi - lo) * k / (n - 1) for k in range(n)]
    below = edges_below(F.coalesce(c_(x), F.lit(0.0)), xsec.edges(df.where(train), x, probs))
    pos = F.least(below, F.lit(n - 1))
    return df.withColumn(f"{x}_rg", probit(F.lit(lo) + F.lit((hi - lo) / (n - 1)) * pos))


def postprocess(df: DataFrame, g: Groups, mode: str, x: str = "pred", symbols: Groups | None = None) -> DataFrame:
    """Demean by time, z by time, or demean by symbol."""
    if mode == "datetime_demean":
        return xsec.with_stats(df, g, {"_m": F.avg(x)}).withColumn(x, c_(x) - c_("_m")).drop("_m")
    if mode == "datetime_zscore":
        df = xsec.with_stats(df, g, {"_m": F.avg(x), "_s": F.stddev_samp(x)})
        z = (c_(x) - c_("_m")) / (F.when(c_("_s") > 0, c_("_s")) + F.lit(1e-12))
        return df.withColumn(x, F.coalesce(z, F.lit(0.0))).drop("_m", "_s")
    if mode == "symbol_demean":
        # a symbol has no size bound: aggregate and join back
        return xsec.with_stats(df, symbols or Groups(("symbol",)), {"_m": F.avg(x)}).withColumn(x, c_(x) - c_("_m")).drop("_m")
    raise ValueError(mode)


def rescale_to_reference(df: DataFrame, x: str, ref: str, fit: Column, out: str) -> DataFrame:
    """Affine map that gives x the mean and deviation of ref on the fit rows, applied everywhere."""
    one = df.where(fit).agg(F.avg(x).alias("_mx"), F.stddev_pop(x).alias("_sx"), F.avg(ref).alias("_mr"), F.stddev_pop(ref).alias("_sr"))
    v = ((c_(x) - c_("_mx")) / F.greatest(c_("_sx"), F.lit(1e-8)) * F.greatest(c_("_sr"), F.lit(1e-8)) + c_("_mr"))
    return df.transform(scalars(one)).withColumn(out, v).drop("_mx", "_sx", "_mr", "_sr")
