"""Deterministic sampling: draws are hashes of the row key, so every run and engine picks the same rows.

Exact quotas come from two-level positions (hash slice, then rank inside the slice); no stratum is
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import edges_below, hash_uniform
from barwright.plans import xsec
from barwright.plans.ordinal import first_n, hash_slice, log_slice, with_ordinal, with_running_sum
from barwright.plans.staging import stage
from barwright.plans.xsec import Groups, scalars

c_ = F.col
TIE = ("symbol", "datetime")
SCORE_RANGES = 256


def draw(seed: int) -> Column:
    return hash_uniform(seed, "symbol", F.date_format("datetime", "yyyy-MM-dd HH:mm"))


def weighted_draw(seed: int, weight: Column) -> Column:
    """The n lowest of ``-ln(u) / w`` are a draw without replacement proportional to w."""
    return -F.ln(F.greatest(draw(seed), F.lit(1e-12))) / weight


def event_weight(score: str = "event_score") -> Column:
    return F.sqrt(F.greatest(F.coalesce(c_(score), F.lit(0.0)), F.lit(0.0)) + F.lit(0.05))


def cap_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all), uniformly."""
    return first_n(df, [], draw(seed), TIE, n)


def rank_bin(rank: str, bins: int) -> Column:
    return F.least(F.greatest(F.floor((F.coalesce(c_(rank), F.lit(0.0)) + F.lit(0.5)) * bins), F.lit(0)), F.lit(bins - 1)).cast("long")


def _quota_then_fill(df: DataFrame, strata: Sequence[str], need: int | Column, per: Column, seed: int, fill: Column,
                     weighted: bool = False) -> DataFrame:
    """``per`` rows from each stratum, then the lowest fill scores until ``need`` rows are reached."""
    marked = with_ordinal(df.withColumn("_u", draw(seed)), list(strata), ["_u", *TIE], hash_slice("_u"), "_pos")
    marked = stage(marked.withColumn("_in", c_("_pos") < per), "quota")
    got = marked.where("_in").agg(F.count(F.lit(1)).alias("_got"))
    rest = marked.where(~c_("_in")).transform(scalars(got))
    need_col = F.lit(need) if isinstance(need, int) else need
    extra = first_n(rest.drop("_u", "_pos"), [], fill, TIE, F.greatest(need_col - c_("_got"), F.lit(0)), weighted)
    return marked.where("_in").drop("_u", "_pos", "_in").unionByName(extra.drop("_in", "_got"))


def stratified(df: DataFrame, n: int, seed: int, rank: str = "label_xrank", bins: int = 8) -> DataFrame:
    """Equal quota per label-rank bin, the remainder filled uniformly."""
    d = df.withColumn("_bin", rank_bin(rank, bins))
    return _quota_then_fill(d, ["_bin"], n, F.lit(max(1, n // bins)), seed, draw(seed + 1)).drop("_bin")


def stratified_months(df: DataFrame, n: int, seed: int, rank: str = "label_xrank", bins: int = 6, weighted_fill: bool = False) -> DataFrame:
    """Equal quota per month and label-rank bin; the fill may prefer eventful rows."""
    d = df.withColumn("_st", F.concat(F.date_format("datetime", "yyyy-MM"), F.lit("/"), rank_bin(rank, bins)))
    k = d.agg(F.count_distinct("_st").alias("_k"))
    d = d.transform(scalars(k))
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / c_("_k")).cast("long"))
    fill = weighted_draw(seed + 1, event_weight()) if weighted_fill else draw(seed + 1)
    return _quota_then_fill(d, ["_st"], n, per, seed, fill, weighted_fill).drop("_st", "_k")


def soft_event(df: DataFrame, n: int, seed: int, fraction: float = 0.25, rank: str = "label_xrank") -> DataFrame:
    """A fraction drawn in proportion to the root of the event score, the rest stratified."""
    k = int(n * fraction)
    scored = with_ordinal(df.withColumn("_u", weighted_draw(seed, event_weight())), [], ["_u", *TIE], log_slice("_u"), "_pos")
    scored = stage(scored, "soft-event")  # read twice below
    event = scored.where(c_("_pos") < k).drop("_u", "_pos")
    rest = scored.where(c_("_pos") >= k).drop("_u", "_pos")
    return event.unionByName(stratified(rest, n - k, seed + 7, rank))


def event_tail(df: DataFrame, n: int, seed: int, q: float = 0.72, share: float = 0.70, rank: str = "label_xrank") -> DataFrame:
    """The top event scores above a quantile up to a share of the sample, the rest by month and bin."""
    d = df.withColumn("event_score", F.coalesce("event_score", F.lit(0.0)))
    d = stage(d, "event-pool")  # read several times below
    high = c_("event_score") >= F.lit((xsec.edges(d, "event_score", [q]) or [0.0])[0])
    # score ranges of about equal size, measured, so that scores of any scale keep their order
    cuts = xsec.edges(d.where(high), "event_score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], distinct=True)
    top = with_ordinal(d.where(high).withColumn("_u", -c_("event_score")), [], ["_u", *TIE], -edges_below("event_score", cuts), "_pos").drop("_u")
    event = top.where(c_("_pos") < int(n * share)).drop("_pos")
    got = event.agg(F.count(F.lit(1)).alias("_g"))
    rest = top.where(c_("_pos") >= int(n * share)).drop("_pos").unionByName(d.where(~high))
    rest = stage(rest, "event-rest")
    st = rest.withColumn("_st", F.concat(F.date_format("datetime", "yyyy-MM"), F.lit("/"), rank_bin(rank, 6)))
    one = st.agg(F.count_distinct("_st").alias("_k")).transform(scalars(got))
    st = st.transform(scalars(one))
    need = F.lit(n) - c_("_g")
    per = F.greatest(F.lit(1), F.floor(need / c_("_k")).cast("long"))
    picked = _quota_then_fill(st.withColumn("_need", need), ["_st"], c_("_need"), per, seed, weighted_draw(seed + 1, event_weight()), True)
    return event.unionByName(picked.drop("_st", "_k", "_g", "_need"))


def recency_sample(df: DataFrame, n: int, seed: int, half_life_days: float) -> DataFrame:
    one = df.agg(F.max("datetime").alias("_last"))
    d = df.transform(scalars(one))
    age = F.timestamp_diff("SECOND", c_("datetime"), c_("_last")) / F.lit(86400.0)
    w = F.greatest(F.exp(F.lit(-0.6931471805599453 / half_life_days) * age), F.lit(1e-12))
    return first_n(d.withColumn("_w", w), [], weighted_draw(seed, c_("_w")), TIE, n, True).drop("_last", "_w")


def whole_timestamps(df: DataFrame, budget: int, min_group: int, seed: int) -> DataFrame:
    """Complete timestamps in hashed order: each that still fits the budget is admitted, and the first one in any case.

    Timestamps with fewer than ``min_group`` rows are not eligible; a frame that fits as a whole is returned as it is. Admission runs in rounds over a
    table of timestamps: the longest prefix of running sums within what is left is admitted, then come those behind it that still fit.
    """
    t = df.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"))
    t = stage(t.withColumn("_u", hash_uniform(seed, F.date_format("datetime", "yyyy-MM-dd HH:mm"))), "timestamps")
    whole = t.agg(F.sum("_n")).first()[0] or 0
    if whole <= budget:
        return df
    t = t.where(c_("_n") >= min_group)
    at = F.struct("_u", "datetime")
    first = t.agg(F.min(F.struct("_u", "datetime", "_n")).alias("f")).first().f
    if first is None:
        return df.limit(0)
    taken = (c_("datetime") == F.lit(first.datetime))
    left, last = budget - first["_n"], F.struct(F.lit(first["_u"]).alias("_u"), F.lit(first.datetime).alias("datetime"))
    while left > 0:  # the table shrinks with every round: each admits a timestamp or ends
        fits = (c_("_n") <= left) & (at > last)
        total = with_running_sum(t.where(fits), ["_u", "datetime"], hash_slice("_u", 1024), "_n", "_total").where(c_("_total") <= left)
        end = total.agg(F.max(at).alias("at"), F.max("_total").alias("total")).first()
        if end.at is None:
            break
        new = F.struct(F.lit(end.at["_u"]).alias("_u"), F.lit(end.at.datetime).alias("datetime"))
        taken = taken | (fits & (at <= new))
        left, last = left - end.total, new
    return df.join(t.where(taken).select("datetime"), "datetime", "left_semi")


def timestamp_batches(df: DataFrame, g: Groups, per_batch: int, symbols: int, min_symbols: int, seed: int) -> DataFrame:
    """At most ``symbols`` members per timestamp, timestamps with enough members numbered into batches."""
    t = df.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n")).where(c_("_n") >= min_symbols)
    t = t.withColumn("_u", hash_uniform(seed, F.date_format("datetime", "yyyy-MM-dd HH:mm")))
    t = with_ordinal(t, [], ["_u", "datetime"], hash_slice("_u"), "_i")
    t = t.select("datetime", F.floor(c_("_i") / per_batch).cast("long").alias("batch"))
    if g.fits:
        w = Window.partitionBy("datetime").orderBy(draw(seed + 1), "symbol")
        picked = df.withColumn("_k", F.row_number().over(w)).where(c_("_k") <= symbols).drop("_k")
    else:
        picked = first_n(df, ["datetime"], draw(seed + 1), TIE, symbols)
    return picked.join(t, "datetime", "inner")


def month_weights(df: DataFrame, month: str, half_life_months: float) -> DataFrame:
    """exp(-ln2 * age in months / half-life) against a test month."""
    age = (F.lit(int(month[:4]) * 12 + int(month[5:7])) - (F.year("datetime") * 12 + F.month("datetime")))
    return df.withColumn("weight", F.exp(F.lit(-0.6931471805599453 / half_life_months) * F.greatest(age, F.lit(0))))


def day_weights(df: DataFrame, end: str, half_life_days: float, lo: float = 0.0, hi: float = 0.0) -> DataFrame:
    """Day-decayed weights, clamped, with mean one."""
    age = F.greatest(F.timestamp_diff("SECOND", c_("datetime"), F.lit(end).cast("timestamp_ntz")) / F.lit(86400.0), F.lit(0.0))
    w = F.exp(F.lit(-0.6931471805599453 / half_life_days) * age)
    w = F.greatest(w, F.lit(lo)) if lo > 0 else w
    w = F.least(w, F.lit(hi)) if hi > 0 else w
    d = df.withColumn("weight", w)
    one = d.agg(F.greatest(F.avg("weight"), F.lit(1e-6)).alias("_m"))
    return d.transform(scalars(one)).withColumn("weight", c_("weight") / c_("_m")).drop("_m")
