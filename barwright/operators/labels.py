"""Forward labels and training targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.expr import clip, div, ln_pos, probit
from barwright.plans import chunks, xsec
from barwright.plans.rolling import Rolling
from barwright.plans.xsec import Groups
from barwright.plans.xsec import scalars


def _ahead_in_session(x: str | Column, h: int) -> Column:
    """Value h bars later, only if the session still holds h bars."""
    return F.when(F.col("bars_to_next_long_break") >= h, F.lead(x, h).over(chunks.bars()))


def simple_label(df: DataFrame, horizon: int = 30, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """close[t+h] / close[t] - 1 counted in bars inside the session."""
    df = chunks.open_chunks(df, 0, horizon, rows)
    df = df.withColumn("label", div(_ahead_in_session("close", horizon), "close") - 1)
    return chunks.close_chunks(df)


def _log_ahead(h: int) -> Column:
    fut = _ahead_in_session("close", h)
    return F.when((F.col("close") > 0) & (fut > 0), F.ln(fut / F.col("close")))


def log_label(df: DataFrame, horizon: int, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    df = chunks.open_chunks(df, 0, horizon, rows)
    return chunks.close_chunks(df.withColumn(f"y_{horizon}", _log_ahead(horizon)))


def multi_horizon_labels(df: DataFrame, horizons: Sequence[int], jump_threshold: int | None = None,
                         rv_horizon: int | None = None, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Log labels per horizon, their validity masks, forward log variance and forward log range."""
    df = chunks.open_chunks(df, 1, max(horizons), rows)
    w = chunks.bars()
    r1 = F.when(~F.col("is_long_break_before"), ln_pos(div("close", F.lag("close").over(w))))
    df = df.withColumn("_r", r1)
    cols: dict[str, Column] = {}
    for h in horizons:
        cols[f"y_{h}"] = _log_ahead(h)
        ok = _log_ahead(h).isNotNull()
        if jump_threshold is not None:
            ok = ok & F.col(f"jump_ok_h{h}_thr{jump_threshold}")
        cols[f"mask_{h}"] = ok
    h = rv_horizon or max(horizons)
    frame = chunks.ahead(h)
    full = F.col("bars_to_next_long_break") >= h
    rv = F.when(full & (F.count("_r").over(frame) == h), F.sum(F.col("_r") * F.col("_r")).over(frame))
    hi, lo = F.max("high").over(frame), F.min("low").over(frame)
    cols["log_rv"] = F.when(rv.isNotNull(), F.ln(rv + F.lit(1e-12)))
    cols["log_range"] = F.when(full & (lo > 0) & (hi > 0), F.ln(hi / lo))
    return chunks.close_chunks(df.withColumns(cols).drop("_r"))


def forward_rv(df: DataFrame, horizon: int, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    return multi_horizon_labels(df, [horizon], None, horizon, rows).drop("log_range", f"y_{horizon}", f"mask_{horizon}")


def forward_range(df: DataFrame, horizon: int, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    return multi_horizon_labels(df, [horizon], None, horizon, rows).drop("log_rv", f"y_{horizon}", f"mask_{horizon}")


def xs_targets(df: DataFrame, g: Groups, y: str, mask: str | Column | None = None, bound: float = 5.0,
               eps: float = 1e-8) -> DataFrame:
    """Cross-sectional z (clipped) and rank in [-1, 1] over the rows the mask admits."""
    use = F.lit(True) if mask is None else (F.col(mask) if isinstance(mask, str) else mask)
    df = df.withColumn("_y", F.when(use, F.col(y)))
    df = xsec.with_stats(df, g, {"_m": F.avg("_y"), "_s": F.stddev_samp("_y")})
    df = xsec.with_rank(df, g, "_y", pct="_p")
    return (df.withColumns({f"{y}_xsz": clip((F.col("_y") - F.col("_m")) / (F.col("_s") + F.lit(eps)), -bound, bound),
                            f"{y}_xrank": F.lit(2.0) * F.col("_p") - 1})
            .drop("_y", "_m", "_s", "_p"))


def standardise_on_train(df: DataFrame, cols: Sequence[str], train: Column, bound: float = 8.0,
                         eps: float = 1e-8) -> DataFrame:
    """Mean and deviation of the train rows only, applied to every row."""
    one = df.where(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                              *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    df = df.transform(scalars(one))  # exactly one row
    return df.withColumns({f"{c}_norm": clip((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(eps)),
                                             -bound, bound) for c in cols}).drop(*one.columns)


def target_transform(df: DataFrame, g: Groups, mode: str, y: str = "label", min_count: int = 8,
                     bound: float = 4.0) -> DataFrame:
    """Targets raw / xsz / xrank / xrank_gauss; small cross-sections give NULL."""
    if mode == "raw":
        return df.withColumn("target", F.col(y))
    df = xsec.with_stats(df, g, {"_n": F.count(y), "_m": F.avg(y), "_s": F.stddev_samp(y)})
    if mode == "xsz":
        t = clip(F.try_divide(F.col(y) - F.col("_m"), F.when(F.col("_s") > 0, F.col("_s"))), -bound, bound)
    else:
        df = xsec.with_rank(df, g, y, rank="_r")
        p = (F.col("_r") - F.lit(0.5)) / F.col("_n")
        t = F.lit(2.0) * p - 1 if mode == "xrank" else probit(clip(p, 1e-4, 1 - 1e-4))
        df = df.withColumn("_t", t).drop("_r")
        t = F.col("_t")
    out = df.withColumn("target", F.when(F.col("_n") >= min_count, t))
    return out.drop("_n", "_m", "_s", "_t")


def auxiliary_targets(df: DataFrame, g: Groups, horizon: int, y: str = "label",
                      rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Absolute, squared, dispersion, z, rank, forward volatility and forward mean range targets."""
    df = chunks.open_chunks(df, 1, horizon, rows)
    df = df.withColumns({
        "_r": F.when(~F.col("is_long_break_before"), ln_pos(div("close", F.lag("close").over(chunks.bars())))),
        "_hl": div(F.col("high") - F.col("low"), "close")})
    frame, full = chunks.ahead(horizon), F.col("bars_to_next_long_break") >= horizon
    df = chunks.close_chunks(df.withColumns({
        "aux_abs": F.abs(y), "aux_sq": F.col(y) * F.col(y),
        "aux_rv": F.when(full, F.sqrt(F.sum(F.col("_r") * F.col("_r")).over(frame))),
        "aux_range": F.when(full, F.avg("_hl").over(frame))}).drop("_r", "_hl"))
    df = xsec.with_stats(df, g, {"_m": F.avg(y), "aux_xs_std": F.stddev_samp(y), "aux_xs_mean_abs": F.avg(F.abs(y))})
    df = xsec.with_rank(df, g, y, pct="_p")
    return df.withColumns({
        "aux_xsz": F.try_divide(F.col(y) - F.col("_m"), F.when(F.col("aux_xs_std") > 0, F.col("aux_xs_std"))),
        "aux_xrank": F.col("_p") - F.lit(0.5),
        "aux_rank_gauss": probit(clip("_p", 0.01, 0.99))}).drop("_m", "_p")


def label_views(df: DataFrame, g: Groups, y: str = "label", bound: float = 8.0, eps: float = 1e-9) -> DataFrame:
    df = xsec.with_stats(df, g, {"_m": F.avg(y), "_s": F.stddev_samp(y)})
    df = xsec.with_rank(df, g, y, pct="_p")
    return df.withColumns({
        "label_xsz": clip((F.col(y) - F.col("_m")) / (F.col("_s") + F.lit(eps)), -bound, bound),
        "label_xrank": F.col("_p") - F.lit(0.5),
        "label_ranknorm": probit(clip("_p", 0.01, 0.99))}).drop("_m", "_s", "_p")


def time_targets(df: DataFrame, g: Groups, horizons: Sequence[int] = (5, 15, 60),
                 rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Forward log returns per symbol without a session cut, and their cross-sectional z."""
    df = chunks.open_chunks(df, 0, max(horizons), rows)
    w = chunks.bars()
    df = chunks.close_chunks(df.withColumns(
        {f"fwd_{h}": ln_pos(div(F.lead("close", h).over(w), "close")) for h in horizons}))
    aggs = {}
    for h in horizons:
        aggs[f"_m{h}"], aggs[f"_s{h}"] = F.avg(f"fwd_{h}"), F.stddev_samp(f"fwd_{h}")
    df = xsec.with_stats(df, g, aggs)
    return df.withColumns({f"fwd_{h}_xsz": (F.col(f"fwd_{h}") - F.col(f"_m{h}")) / (F.col(f"_s{h}") + F.lit(1e-9))
                           for h in horizons}).drop(*aggs)


def residual_target(df: DataFrame, pred: str, y: str, train: Column | None = None, bound: float = 8.0) -> DataFrame:
    """y - beta * pred with beta = p'y / p'p on the train rows."""
    src = df.where(train) if train is not None else df
    one = src.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).agg(
        F.try_divide(F.sum(F.col(pred) * F.col(y)), F.sum(F.col(pred) * F.col(pred))).alias("beta"))
    return (df.transform(scalars(one))
            .withColumn("residual", clip(F.col(y) - F.col("beta") * F.col(pred), -bound, bound)))


def residual_label(pred: str, y: str, bound: float | None = None) -> Column:
    r = F.col(y) - F.col(pred)
    return clip(r, -bound, bound) if bound else r


def winsorised_target(df: DataFrame, y: str, train: Column, q: float = 0.01) -> DataFrame:
    """Clip to the [q, 1-q] quantiles of the train rows, then standardise with their moments."""
    src = df.where(train)
    lo, hi = xsec.edges(src, y, [q, 1 - q]) or (float("-inf"), float("inf"))
    cut = lambda d: d.withColumn("target_w", clip(y, lo, hi))
    one = cut(src).agg(F.avg("target_w").alias("_m"), F.stddev_pop("target_w").alias("_s"))
    return (cut(df).transform(scalars(one))
            .withColumn("target_std", (F.col("target_w") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-8)))
            .drop("_m", "_s"))
