"""Session detection and session-aware masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import hash_uniform, ln_pos, minute_of_day
from barwright.plans import chunks, xsec
from barwright.plans.ordinal import time_bucket, with_codes
from barwright.plans.rolling import Rolling

UNBOUND = (Window.unboundedPreceding, 0)


def add_sessions(bars: DataFrame, gap_minutes: float = 60.0, bucket_seconds: int = 604800,
                 strict: bool = False) -> DataFrame:
    """Gaps, long breaks, session id and positions.

    Each symbol is cut into calendar buckets. What a bucket must know of the bars before and after
    it (bar count, last time, breaks so far, nearest break) is carried by the small table of
    bucket summaries, so a symbol's history never sits in one task. ``bars`` is read twice (for the
    summaries and for the rows); pass a stored table where it is costly to compute.
    """
    by = ["symbol", "_bk"]
    inner = Window.partitionBy(*by).orderBy("datetime")
    seq = Window.partitionBy("symbol").orderBy("_bk")  # bucket summaries only
    before, behind = seq.rowsBetween(Window.unboundedPreceding, -1), seq.rowsBetween(1, Window.unboundedFollowing)

    def minutes(earlier: Column, later: Column) -> Column:
        return F.coalesce(F.timestamp_diff("SECOND", earlier, later) / F.lit(60.0), F.lit(0.0))

    def breaks(gap: Column) -> Column:
        return gap > gap_minutes if strict else gap >= gap_minutes

    x = (bars.withColumn("_bk", time_bucket("datetime", bucket_seconds))
         .withColumns({"_rn": F.row_number().over(inner), "_prev": F.lag("datetime").over(inner)}))
    inside = F.when(F.col("_prev").isNotNull() & breaks(minutes(F.col("_prev"), F.col("datetime"))), F.col("_rn") - 1)
    # all a bucket must say of itself, in one aggregate over the window above
    told = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("datetime").alias("_first"), F.max("datetime").alias("_last"),
                              F.count(inside).alias("_in"), F.max(inside).alias("_hi"), F.min(inside).alias("_lo"))
    told = told.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_prev_last": F.lag("_last").over(seq),
                             "symbol_bars": F.sum("_n").over(Window.partitionBy("symbol"))})
    told = told.withColumn("_cut", F.col("_prev_last").isNotNull() & breaks(minutes(F.col("_prev_last"), F.col("_first"))))
    told = told.withColumns({"_k": F.col("_in") + F.col("_cut").cast("long"),
                             "_hi": F.col("_off") + F.coalesce("_hi", F.when(F.col("_cut"), F.lit(0))),
                             "_lo": F.col("_off") + F.when(F.col("_cut"), F.lit(0)).otherwise(F.col("_lo"))})
    carry = told.select(
        *by, "_off", "_prev_last", "symbol_bars", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"),
        F.coalesce(F.max("_hi").over(before), F.lit(0)).alias("_s0"), F.min("_lo").over(behind).alias("_e0"))
    y = x.join(carry, by, "inner")
    y = y.withColumns({"bar_no": F.col("_off") + F.col("_rn") - 1,
                       "gap_min": minutes(F.coalesce("_prev", "_prev_last"), F.col("datetime"))})
    y = y.withColumn("is_long_break_before", breaks(F.col("gap_min")))
    y = y.withColumn("_at", F.when(F.col("is_long_break_before"), F.col("bar_no")))
    start = F.greatest(F.col("_s0"), F.coalesce(F.max("_at").over(inner.rowsBetween(*UNBOUND)), F.lit(0)))
    stop = F.least(F.min("_at").over(inner.rowsBetween(1, Window.unboundedFollowing)), F.col("_e0"),
                   F.col("symbol_bars"))
    y = y.withColumns({
        "session_id": F.col("_k0") + F.count("_at").over(inner.rowsBetween(*UNBOUND)),
        "session_pos": F.col("bar_no") - start,
        "bars_to_next_long_break": stop - F.lit(1) - F.col("bar_no")})
    return y.drop("_bk", "_rn", "_prev", "_off", "_prev_last", "_at", "_k0", "_s0", "_e0")


def add_calendar(df: DataFrame) -> DataFrame:
    h = F.hour("datetime")
    return df.withColumns({
        "session_type": F.when((h >= 20) | (h < 8), F.lit("night")).otherwise(F.lit("day")),
        "minute_of_day": minute_of_day("datetime"), "month": F.month("datetime")})


def bars_since_break() -> Column:
    """0 on a break bar, counting up; the very first bar of a symbol counts as 1."""
    return F.col("session_pos") + F.when(F.col("session_id") == 0, F.lit(1)).otherwise(F.lit(0))


def masked(x: Column, lookback: int) -> Column:
    """NULL where the lookback would reach over a long break."""
    return F.when(bars_since_break() >= lookback, x)


def session_key(df: DataFrame) -> DataFrame:
    """64-bit key: symbol code in the high half, session number in the low half."""
    return with_codes(df, "symbol", "symbol_code").withColumn(
        "session_key", F.shiftleft(F.col("symbol_code").cast("long"), 32) + F.col("session_id"))


def bars_to_month_end(df: DataFrame) -> DataFrame:
    """Bars left in the symbol's month; a (symbol, month) group is bounded by the calendar."""
    w = Window.partitionBy("symbol", F.date_format("datetime", "yyyy-MM")).orderBy(F.col("datetime").desc())
    return df.withColumn("bars_to_month_end", F.row_number().over(w) - 1)


def add_jump_risk(df: DataFrame, window: int = 240, min_periods: int = 60,
                  thresholds: Sequence[int] = (8, 12, 16), rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Robust z of the log return against prior-only median and MAD, and jump flags."""
    df = chunks.open_chunks(df, 2 * window + 2, 0, rows)
    w = chunks.bars()
    ret = F.when(~F.col("is_long_break_before"), ln_pos(F.try_divide(
        F.when(F.col("close") != 0, F.col("close")), F.lag(F.when(F.col("close") != 0, F.col("close"))).over(w))))
    df = df.withColumn("ret_1", ret)

    def median(x: str, frame) -> Column:
        return F.when(F.count(x).over(frame) >= min_periods, F.percentile(x, F.lit(0.5)).over(frame))

    df = df.withColumns({"_med": median("ret_1", chunks.prior(window)), "_lag_ret": F.lag("ret_1").over(w)})
    df = df.withColumn("_dev", F.abs(F.col("_lag_ret") - F.col("_med")))
    df = df.withColumn("_mad", median("_dev", chunks.trailing(window)) * F.lit(1.4826))
    z = (F.col("ret_1") - F.col("_med")) / (F.col("_mad") + F.lit(1e-8))
    df = df.withColumn("ret_robust_z", z)
    df = df.withColumns({f"jump_risk_{t}": F.coalesce(F.abs("ret_robust_z") > F.lit(float(t)), F.lit(False))
                         for t in thresholds})
    return chunks.close_chunks(df.drop("_med", "_lag_ret", "_dev", "_mad"))


def add_horizon_masks(df: DataFrame, horizons: Sequence[int], thresholds: Sequence[int],
                      rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Label windows (t, t+h] that stay in the session and hold no jump bar."""
    df = chunks.open_chunks(df, 0, max(horizons), rows)
    cols = {}
    for t in thresholds:
        flag = F.col(f"jump_risk_{t}").cast("int")
        for h in horizons:
            clean = F.coalesce(F.sum(flag).over(chunks.ahead(h)), F.lit(0)) == 0
            cols[f"jump_ok_h{h}_thr{t}"] = clean & (F.col("bars_to_next_long_break") >= h)
    return chunks.close_chunks(df.withColumns(cols))


def jump_summary(df: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Jump bars and their share per threshold, with the unfiltered row first."""
    sums = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.sum(F.col(f"jump_risk_{t}").cast("long")).alias(f"j{t}") for t in thresholds])
    rows = [F.struct(F.lit("no_filter").alias("threshold"), F.lit(0).cast("long").alias("jump_bars"))]
    rows += [F.struct(F.lit(str(t)).alias("threshold"), F.col(f"j{t}").alias("jump_bars")) for t in thresholds]
    return (sums.select("n", F.inline(F.array(*rows)))
            .select("threshold", "jump_bars",
                    (F.col("jump_bars") / F.greatest(F.col("n"), F.lit(1))).alias("jump_bar_pct")))


def raw_vwap() -> Column:
    return F.try_divide(F.col("amount"), F.when(F.col("volume") != 0, F.col("volume")))


def roll_candidates(df: DataFrame, min_jump: float = 0.015, mad_multiplier: float = 10.0,
                    largest: int | None = None, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Bars where log(proxy / close) moves by more than max(min_jump, m * MAD) of the symbol."""
    r = Rolling(df, 1, 0, rows)
    r.define(_lf=ln_pos(F.try_divide(raw_vwap(), F.when(F.col("close") != 0, F.col("close")))))
    r.define(log_factor_jump=F.col("_lf") - r.lag("_lf"))
    jumps = r.close()
    med = xsec.quantiles(jumps, ["symbol"], "log_factor_jump", [0.5], largest, "_m")
    dev = jumps.join(med, "symbol").withColumn("_d", F.abs(F.col("log_factor_jump") - F.col("_m")[0]))
    mad = xsec.quantiles(dev, ["symbol"], "_d", [0.5], largest, "_q")
    limit = F.greatest(F.lit(min_jump), F.lit(mad_multiplier) * F.lit(1.4826) * F.col("_q")[0])
    return (jumps.join(mad.select("symbol", limit.alias("roll_threshold")), "symbol")
            .withColumn("abs_log_factor_jump", F.abs("log_factor_jump"))
            .where(F.col("abs_log_factor_jump") > F.col("roll_threshold")).drop("_lf"))


def invalid_near(df: DataFrame, flag: str, bars: int = 60, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """True within +-``bars`` bars of a flagged bar."""
    df = chunks.open_chunks(df, bars, bars, rows)
    near = F.max(F.col(flag).cast("int")).over(chunks.bars().rowsBetween(-bars, bars)) == 1
    return chunks.close_chunks(df.withColumn("near_roll", near))


def quality_report(bars: DataFrame, bucket_seconds: int = 604800) -> DataFrame:
    """Contract violations per symbol: duplicates, seconds, missing closes, high below low."""
    keyed = bars.groupBy("symbol", "datetime").agg(
        F.count(F.lit(1)).alias("n"), F.count("close").alias("closes"),
        F.sum((F.col("high") < F.col("low")).cast("long")).alias("crossed"))
    return keyed.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
        F.sum((F.second("datetime") != 0).cast("long")).alias("off_minute"),
        F.sum("crossed").alias("crossed_bars"),
        (F.sum("closes") / F.sum("n")).alias("close_coverage"),
        (F.sum("closes") / F.sum("n") > 0.5).alias("coverage_ok"))


REQUIRED = ("symbol", "datetime", "open", "high", "low", "close", "volume", "amount", "oi")


def order_report(bars: DataFrame, place: Sequence[str]) -> DataFrame:
    """symbol, falls: how often a bar is earlier than the one stored before it, without sorting the bars.

    ``place`` names the columns (text, long) that tell where a row is stored: a file and its row there. Tasks read rows as they are stored and
    report each symbol's first and last time in every stretch, and the falls inside; stretches are then compared at their edges.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            t["ns"] = t["datetime"].astype("int64")
            if not len(t):
                continue
            keys = ["file", "symbol"]
            t["fall"] = t.groupby(keys, dropna=False, sort=False)["ns"].diff().lt(0)
            g = t.groupby(keys, dropna=False, sort=False)
            one = g.agg(at=("row", "min"), first=("ns", "first"), last=("ns", "last"), falls=("fall", "sum")).reset_index()
            yield pa.RecordBatch.from_pandas(one[["symbol", "file", "at", "first", "last", "falls"]].astype({"falls": np.int64}), preserve_index=False)

    rows = bars.select("symbol", "datetime", F.col(place[0]).cast("string").alias("file"), F.col(place[1]).cast("long").alias("row")).where("datetime IS NOT NULL")
    parts = rows.mapInArrow(each, "symbol string, file string, at long, first long, last long, falls long")
    stored = Window.partitionBy("symbol").orderBy("file", "at")  # stretches only
    edges = parts.withColumn("edge", F.coalesce((F.col("first") < F.lag("last").over(stored)).cast("long"), F.lit(0)))
    return edges.groupBy("symbol").agg(F.sum(F.col("falls") + F.col("edge")).alias("falls"))


def bar_contract(bars: DataFrame, place: Sequence[str] | None = None, min_coverage: float = 0.5) -> DataFrame:
    """Per symbol what a bar table must fulfil: required columns, order, unique keys, whole minutes, closes, amounts and open interest.

    ``bars`` may lack columns: the report then names them and leaves out what it cannot say. ``holds`` sums up all conditions. ``place`` as in
    ``order_report``; without it the order is not reported.
    """
    absent = [c for c in REQUIRED if c not in bars.columns]
    share = lambda c: (F.sum(f"_{c}") / F.sum("n")).alias(f"{c}_share")
    have = [c for c in ("close", "amount", "oi") if c not in absent]
    keyed = bars.groupBy("symbol", "datetime").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"_{c}") for c in have])
    out = keyed.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.sum(F.col("n") - 1).alias("duplicate_keys"),
        F.sum((F.second("datetime") != 0).cast("long")).alias("off_minute"),
        F.sum((F.date_format("datetime", "SSSSSS") != "000000").cast("long")).alias("off_second"), *[share(c) for c in have])
    holds = (F.lit(not absent) & (F.col("duplicate_keys") == 0) & (F.col("off_minute") == 0) & (F.col("off_second") == 0))
    for c in have:
        holds = holds & (F.col(f"{c}_share") > (min_coverage if c == "close" else 0.0))
    if place is not None:
        out = out.join(order_report(bars, place), "symbol")
        holds = holds & (F.col("falls") == 0)
    return out.withColumns({"missing_columns": F.lit(",".join(absent)), "holds": holds})


def panel_contract(panel: DataFrame, horizon: int, gap_minutes: float, y: str = "label", seed: int = 42) -> DataFrame:
    """Per symbol of a panel with sessions and labels: sessions, breaks, label coverage, labels that reach over a break, IC of a random prediction.

    The prediction is a hash of symbol and time, so that any engine can make it.
    """
    noise = hash_uniform(seed, "symbol", F.date_format("datetime", "yyyy-MM-dd HH:mm")) - F.lit(0.5)
    d = panel.withColumn("_p", F.when(F.col(y).isNotNull(), noise))
    yes = lambda c: F.sum(c.cast("long"))
    long_gap = F.col("gap_min") >= gap_minutes
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max("session_id") - F.min("session_id") + 1).alias("sessions"), yes(long_gap).alias("long_breaks"),
        yes((F.col("gap_min") > 1) & ~long_gap).alias("short_breaks"), F.max("gap_min").alias("max_gap_min"),
        (F.count(y) / F.count(F.lit(1))).alias("label_coverage"),
        yes((F.col("bars_to_next_long_break") < horizon) & F.col(y).isNotNull()).alias("labels_over_break"),
        F.try_divide(F.sum(F.col("_p") * F.col(y)), F.sqrt(F.sum(F.col("_p") * F.col("_p")) * F.sum(F.col(y) * F.col(y)))).alias("random_ic"))
