"""Walk-forward splits with embargo, and the window index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.plans import chunks
from barwright.plans.xsec import scalars

c_ = F.col


def span(panel: DataFrame) -> DataFrame:
    """First and last day of the panel (one row)."""
    return panel.agg(F.min("datetime").cast("date").alias("first_day"), F.max("datetime").cast("date").alias("last_day"))


def month_splits(panel: DataFrame, step: int = 1, embargo_days: int = 1, warm_months: int = 12, partial: bool = True) -> DataFrame:
    """Splits every ``step`` months from the panel's own span; the last may be partial."""
    s = span(panel).withColumn("_m0", F.trunc("first_day", "month"))
    starts = s.withColumn("eval_start", F.explode(F.sequence(
        F.add_months("_m0", warm_months), F.col("last_day"), F.expr(f"interval {step} month"))))
    full = F.add_months("eval_start", step)
    end = F.least(full, F.date_add("last_day", 1))
    y = F.year("eval_start")
    label = (F.concat(y, F.lit("Q"), F.quarter("eval_start")) if step == 3
             else F.concat(y, F.lit("-"), F.lpad(F.month("eval_start").cast("string"), 2, "0")) if step == 1
             else F.concat(y, F.lit("M"), F.lpad(F.month("eval_start").cast("string"), 2, "0")))
    out = starts.select(
        F.concat(label, F.when(end < full, F.lit("_partial")).otherwise(F.lit(""))).alias("split"),
        c_("first_day").alias("train_start"), F.date_sub("eval_start", embargo_days).alias("train_end"), "eval_start", end.alias("eval_end"),
        (end < full).alias("is_partial"))
    return out if partial else out.where(~c_("is_partial"))


def representative(splits: DataFrame, months: Sequence[int]) -> DataFrame:
    return splits.where(F.month("eval_start").isin(*months))


def split_rows(panel: DataFrame, splits: DataFrame, ok: Column) -> DataFrame:
    """Train and evaluation rows of every split, from counts per day.

    The range join pairs the calendar with the split list; panel rows are aggregated first.
    """
    days = panel.where(ok).groupBy(c_("datetime").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    inside = (days["day"] >= splits["train_start"]) & (days["day"] < splits["eval_end"])
    j = splits.join(days, inside, "left")
    part = lambda lo, hi: F.sum(F.when((c_("day") >= c_(lo)) & (c_("day") < c_(hi)), c_("_n")).otherwise(0))
    return j.groupBy("split").agg(part("train_start", "train_end").alias("n_train"), part("eval_start", "eval_end").alias("n_eval"))


def three_way(splits: DataFrame, val_months: int, embargo_days: int) -> DataFrame:
    """Train / validation / test ranges with an embargo before validation and before test."""
    v0 = F.greatest(c_("train_start"), F.add_months("eval_start", -val_months))
    return splits.select("split", "train_start", F.date_sub(v0, embargo_days).alias("train_end"), v0.alias("val_start"),
                         F.date_sub("eval_start", embargo_days).alias("val_end"), c_("eval_start").alias("test_start"), c_("eval_end").alias("test_end"))


def outer_folds(panel: DataFrame, year: int, mode: str = "expanding") -> DataFrame:
    """Folds q2, q3, q4 and h2 of a year with fit windows expanding / last6 / last3 over the months present."""
    months = panel.select(F.date_format("datetime", "yyyy-MM").alias("month")).distinct()
    folds = [("q2", 4, 6), ("q3", 7, 9), ("q4", 10, 12), ("h2", 7, 12)]
    spec = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(f"{year}-{a:02d}").alias("v0"), F.lit(f"{year}-{b:02d}").alias("v1")) for n, a, b in folds])
    m = months.where(F.substring("month", 1, 4) == str(year)).select("month", F.inline(spec))
    back = F.row_number().over(Window.partitionBy("fold", "_fit").orderBy(F.desc("month")))  # twelve months a fold
    m = m.withColumn("_fit", c_("month") < c_("v0")).withColumn("_back", back)
    limit = {"expanding": 10 ** 6, "last6": 6, "last3": 3}[mode]
    role = F.when(c_("_fit") & (c_("_back") <= limit), F.lit("fit")).when(c_("month").between(c_("v0"), c_("v1")), F.lit("validate"))
    return m.select("fold", "month", role.alias("role")).where("role is not null")


def embargo_before_month(panel: DataFrame, month: str, embargo_bars: int, start: str | None = None) -> DataFrame:
    """Train rows before a month, leaving out the last bars before each symbol's first bar of that month."""
    key = F.date_format("datetime", "yyyy-MM")
    first = panel.where(key == month).groupBy("symbol").agg(F.min("bar_no").alias("_cut"))
    d = panel.where(key < month)
    if start:
        d = d.where(c_("datetime") >= F.lit(start).cast("timestamp_ntz"))
    return (d.join(first, "symbol", "left")
            .where(c_("_cut").isNull() | (c_("bar_no") < c_("_cut") - embargo_bars)).drop("_cut"))


def month_end_embargo(panel: DataFrame, month: str, embargo_bars: int, lookback_months: int = 0) -> DataFrame:
    """Prior months whole, but the month just before the test month loses its last bars per symbol."""
    from barwright.operators.sessions import bars_to_month_end
    key = F.date_format("datetime", "yyyy-MM")
    prev = F.date_format(F.add_months(F.lit(month + "-01").cast("date"), -1), "yyyy-MM")
    d = bars_to_month_end(panel).where(key < month)
    if lookback_months:
        d = d.where(key >= F.date_format(F.add_months(F.lit(month + "-01").cast("date"), -lookback_months), "yyyy-MM"))
    return d.where((key != prev) | (c_("bars_to_month_end") >= embargo_bars))


# ---- window index -------------------------------------------------------------------------------
def window_index(panel: DataFrame, length: int, start: str, end: str, target: str | None = "label", stride: int = 1,
                 allow_short: bool = False, scope: str = "session") -> DataFrame:
    """Anchors (symbol, row) with a full lookback, on the stride, in the date range, with a target."""
    pos = c_("session_pos") if scope == "session" else c_("bar_no")
    ok = (c_("datetime") >= F.lit(start).cast("timestamp_ntz")) & (c_("datetime") < F.lit(end).cast("timestamp_ntz")) & (pos % stride == 0)
    if not allow_short:
        ok = ok & (pos >= length - 1)
    if target:
        ok = ok & c_(target).isNotNull()
    return panel.where(ok)


def materialise_windows(panel: DataFrame, cols: Sequence[str], length: int, anchor: Column, scope: str = "session",
                        rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """One array of structs per anchor: the last ``length`` bars, zero-padded on the left.

    Frames are bounded by ``length`` and chunked, so an array never grows with the data.
    """
    d = chunks.open_chunks(panel, length, 0, rows)
    w = chunks.bars(scope == "session").rowsBetween(-(length - 1), 0)
    item = F.struct(*[F.coalesce(c_(x).cast("double"), F.lit(0.0)).alias(x) for x in cols])
    zero = F.struct(*[F.lit(0.0).alias(x) for x in cols])
    d = d.withColumn("_w", F.collect_list(item).over(w))
    d = chunks.close_chunks(d).where(anchor)
    return d.withColumn("window", F.concat(F.array_repeat(zero, F.lit(length) - F.size("_w")), c_("_w"))).drop("_w")


def strided_windows(panel: DataFrame, cols: Sequence[str], length: int, stride: int, anchor: Column, scope: str = "session") -> DataFrame:
    """The windows of ``materialise_windows`` for the anchors on the stride alone.

    Each bar goes to the anchors whose window holds it, at most ``length / stride`` of them rounded up, instead of every bar
    getting an array. Anchors are the bars on the stride for which ``anchor`` is true; a group never holds more than ``length`` bars.
    """
    keys = ["symbol", "session_id"] if scope == "session" else ["symbol"]
    pos = c_("session_pos") if scope == "session" else c_("bar_no")
    item = F.struct(pos.alias("_pos"), *[F.coalesce(c_(x).cast("double"), F.lit(0.0)).alias(x) for x in cols])
    first = F.expr(f"({'session_pos' if scope == 'session' else 'bar_no'} + {stride - 1}) div {stride} * {stride}")
    held = F.when(first <= pos + (length - 1), F.sequence(first, pos + (length - 1), F.lit(stride).cast("long")))
    rest = F.when((c_("_at") == pos) & anchor, F.struct(*[c_(x) for x in panel.columns if x not in keys]))
    d = panel.withColumn("_at", F.explode(held))
    d = d.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(item)).alias("_w"), F.first(rest, ignorenulls=True).alias("_row"))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in cols])
    values = F.transform("_w", lambda s: F.struct(*[s[x].alias(x) for x in cols]))
    window = F.concat(F.array_repeat(zero, F.lit(length) - F.size("_w")), values)
    return d.where(c_("_row").isNotNull()).select(*keys, "_row.*", window.alias("window"))


def train_scale(index: DataFrame, target: str, train: Column) -> DataFrame:
    """Target standardised with the mean and deviation of the train anchors."""
    one = index.where(train).agg(F.avg(target).alias("_m"), F.stddev_pop(target).alias("_s"))
    return (index.transform(scalars(one))
            .withColumn("target_z", (c_(target) - c_("_m")) / F.greatest(c_("_s"), F.lit(1e-8))).drop("_m", "_s"))


def predictions_to_frame(panel: DataFrame, index_preds: DataFrame, mask: str | None = None) -> DataFrame:
    """Predictions made per (symbol, bar_no) back on the panel key; masked rows are left out."""
    j = panel.join(index_preds, ["symbol", "bar_no"], "inner")
    return j.where(c_(mask)) if mask else j
