"""Information-coefficient evaluation. Every score is built from additive sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import col, edges_below, hash_uniform, month_key
from barwright.operators import views
from barwright.plans import xsec
from barwright.plans.ordinal import hash_slice, time_bucket, with_ordinal, with_running_sum
from barwright.plans.xsec import Groups
from barwright.plans.xsec import scalars

c_ = F.col
YEAR = 31536000


def both(p: str, y: str) -> Column:
    return c_(p).isNotNull() & c_(y).isNotNull()


def ic(p: str | Column, y: str | Column) -> Column:
    """Uncentred cosine of prediction and label over the rows that have both (an aggregate)."""
    a, b = col(p), col(y)
    ok = a.isNotNull() & b.isNotNull()
    s = lambda v: F.sum(F.when(ok, v))
    root = F.sqrt(s(a * a) * s(b * b))
    return F.when(F.sum(ok.cast("long")) >= 2, F.try_divide(s(a * b), F.when(root > 1e-12, root)))


def pearson(p: str | Column, y: str | Column) -> Column:
    """Centred correlation as an aggregate; NULL when a side does not vary."""
    a, b = col(p), col(y)
    ok = a.isNotNull() & b.isNotNull()
    v = lambda x: F.when(ok, x)
    va, vb = F.var_pop(v(a)), F.var_pop(v(b))
    return F.try_divide(F.covar_pop(v(a), v(b)), F.when((va > 1e-18) & (vb > 1e-18), F.sqrt(va * vb)))


def pooled_ic(df: DataFrame, p: str, y: str = "label") -> DataFrame:
    return df.agg(ic(p, y).alias("ic"), F.count_if(both(p, y)).alias("n"))


def ic_by_period(df: DataFrame, p: str, y: str = "label", period: Column | None = None, name: str = "month") -> DataFrame:
    key = (period if period is not None else month_key("datetime")).alias(name)
    return df.groupBy(key).agg(ic(p, y).alias("ic"), F.count_if(both(p, y)).alias("n"))


def ic_summary(df: DataFrame, p: str, y: str = "label", years: Sequence[str] = ()) -> DataFrame:
    """Total IC, monthly mean, deviation and ratio, coverage, and one column per year.

    Months are folded from per-month sums, so the rows are read once.
    """
    ok = both(p, y)
    s = lambda v: F.sum(F.when(ok, v))
    a, b = c_(p), c_(y)
    months = df.groupBy(month_key("datetime").alias("month")).agg(
        s(a * b).alias("xy"), s(a * a).alias("xx"), s(b * b).alias("yy"), F.sum(ok.cast("long")).alias("n"),
        F.count(F.lit(1)).alias("rows"))
    cos = lambda cond=None: F.try_divide(
        F.sum(F.when(cond, c_("xy")) if cond is not None else c_("xy")),
        F.sqrt(F.sum(F.when(cond, c_("xx")) if cond is not None else c_("xx")) * F.sum(F.when(cond, c_("yy")) if cond is not None else c_("yy"))))
    m = F.when(c_("n") >= 2, F.try_divide(c_("xy"), F.sqrt(c_("xx") * c_("yy"))))
    return months.agg(
        cos().alias("ic"), F.avg(m).alias("monthly_mean"), F.stddev_samp(m).alias("monthly_std"),
        F.try_divide(F.avg(m), F.stddev_samp(m)).alias("monthly_ir"), (F.sum("n") / F.sum("rows")).alias("coverage"),
        F.sum("n").alias("n"), *[cos(F.substring("month", 1, 4) == v).alias(f"ic_{v}") for v in years])


def rank_ic(df: DataFrame, p: str, y: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation with average ranks, overall or per key; ranks come from value counts."""
    g = Groups(tuple(keys))
    rows = df.where(both(p, y)).select(*keys, p, y)
    rows = xsec.with_rank(xsec.with_rank(rows, g, p, rank="_rp"), g, y, rank="_ry")
    return rows.groupBy(*keys).agg(pearson("_rp", "_ry").alias("rank_ic"), F.count(F.lit(1)).alias("n"))


def merged_ic(df: DataFrame, p: str, y: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(pearson(p, y).alias("merged_ic"), F.count_if(both(p, y)).alias("n"))


def metric_by_group(df: DataFrame, keys: Sequence[str], p: str, y: str = "label") -> DataFrame:
    """n, IC and rank IC per group (symbol, month, year)."""
    base = df.where(both(p, y)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ic(p, y).alias("ic"))
    ranks = rank_ic(df, p, y, keys).select(*keys, "rank_ic")
    return base.join(ranks, list(keys), "left")


def ic_series(df: DataFrame, g: Groups, p: str, y: str = "label", min_symbols: int = 10, rank: bool = False,
              stride: int = 1, score: str = "pearson") -> DataFrame:
    """One cross-sectional score per timestamp that has enough symbols, every ``stride``-th kept."""
    rows = df.where(both(p, y)).select("datetime", p, y)
    a, b = p, y
    if rank:
        rows = xsec.with_rank(xsec.with_rank(rows, g, p, rank="_rp"), g, y, rank="_ry")
        a, b = "_rp", "_ry"
    fn = pearson if score == "pearson" else ic
    out = (rows.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), fn(a, b).alias("ic"))
           .where(c_("n") >= min_symbols))
    if stride > 1:
        out = with_ordinal(out, [], ["datetime"], time_bucket("datetime", YEAR), "_i")
        out = out.where(c_("_i") % stride == 0).drop("_i")
    h = F.hour("datetime")
    return out.withColumns({"month": month_key("datetime"),
                            "session_type": F.when((h >= 20) | (h < 8), F.lit("night")).otherwise(F.lit("day"))})


def stride_ics(df: DataFrame, g: Groups, p: str, y: str = "label", stride: int = 30) -> DataFrame:
    """Pooled, dense, non-overlapping and sector-neutral non-overlapping IC in one row."""
    d = df.where(both(p, y)).select("datetime", "sector", c_(p).alias("p"), c_(y).alias("y"))
    d = xsec.with_stats(d, g.within("sector"), {"_m": F.avg("p")}).withColumn("sn", c_("p") - c_("_m"))
    per = d.groupBy("datetime").agg(
        F.covar_pop("p", "y").alias("c"), F.var_pop("p").alias("vp"), F.var_pop("y").alias("vy"),
        F.covar_pop("sn", "y").alias("cs"), F.var_pop("sn").alias("vs"),
        F.sum(c_("p") * c_("y")).alias("xy"), F.sum(c_("p") * c_("p")).alias("xx"), F.sum(c_("y") * c_("y")).alias("yy"))
    per = with_ordinal(per, [], ["datetime"], time_bucket("datetime", YEAR), "_i")
    root = lambda v: F.sqrt(c_(v) * c_("vy"))
    raw = F.try_divide(c_("c"), F.when(root("vp") > 1e-15, root("vp")))
    sn = F.try_divide(c_("cs"), F.when(root("vs") > 1e-15, root("vs")))
    pick = c_("_i") % stride == 0
    return per.agg(
        (F.sum("xy") / F.sqrt(F.sum("xx") * F.sum("yy"))).alias("pooled_ic"),
        F.avg(F.when(pick, sn)).alias("sn_nonoverlap_ic"), F.avg(F.when(pick, raw)).alias("raw_nonoverlap_ic"),
        F.avg(raw).alias("dense_cs_ic"), F.count(F.when(pick, raw)).alias("n_nonoverlap"), F.count(raw).alias("n_dense"))


def summarise_series(series: DataFrame, keys: Sequence[str] = (), x: str = "ic") -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.try_divide(F.avg(x), F.stddev_samp(x)).alias("icir"))


def newey_west(series: DataFrame, x: str = "ic", lag: int = 5, bucket_seconds: int = YEAR) -> DataFrame:
    """t statistic of the mean with Bartlett weights.

    Pairs at distance k are an equi-join on position, so no task holds the whole series.
    """
    s = series.where(c_(x).isNotNull()).select("datetime", x)
    s = with_ordinal(s, [], ["datetime"], time_bucket("datetime", bucket_seconds), "i")
    one = s.agg(F.avg(x).alias("_mu"), F.count(x).alias("_n"))
    s = s.transform(scalars(one)).select("i", (c_(x) - c_("_mu")).alias("a"), "_mu", "_n")
    back = s.select(c_("a").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(lag))).alias("k"), "i")
    back = back.select("b", "k", (c_("i") + c_("k")).alias("i"))
    gamma = (s.join(back, "i").groupBy("k")
             .agg((F.sum(c_("a") * c_("b")) / F.count(F.lit(1))).alias("g"), F.first("_mu").alias("mu"), F.first("_n").alias("n")))
    top = F.least(F.lit(lag), c_("n") - 1)
    w = F.when(c_("k") == 0, F.lit(1.0)).when(c_("k") <= top, F.lit(2.0) * (F.lit(1.0) - c_("k") / (top + 1.0))).otherwise(0.0)
    return (gamma.agg(F.sum(w * c_("g")).alias("v"), F.first("mu").alias("mean"), F.first("n").alias("n"))
            .select("n", "mean", F.when(c_("n") >= 3, c_("mean") / F.sqrt(F.greatest(c_("v"), F.lit(1e-18)) / c_("n"))).alias("t_stat")))


def bootstrap_ci(series: DataFrame, x: str = "ic", block: int = 20, draws: int = 1000, seed: int = 11,
                 method: str = "blocks", bucket_seconds: int = YEAR) -> DataFrame:
    """95 % interval of the mean: n, lo, hi. ``method`` is ``blocks`` (moving-block bootstrap, at any length) or ``normal``.

    Block starts are hashed draws; a block is read from running sums at its two ends, so each draw
    costs its number of blocks, not the length of the series. A series shorter than a block has no interval.
    """
    s = series.where(c_(x).isNotNull()).select("datetime", x)
    if method == "normal":
        half = F.lit(1.96) * F.stddev_samp(x) / F.sqrt(F.count(x))
        return s.agg(F.count(x).alias("n"), (F.avg(x) - half).alias("lo"), (F.avg(x) + half).alias("hi"))
    if method != "blocks":
        raise ValueError(f"unknown method {method}")
    one = s.agg(F.count(x).alias("n"))
    bucket = time_bucket("datetime", bucket_seconds)
    pos = with_ordinal(s, [], ["datetime"], bucket, "i")
    cum = with_running_sum(pos, ["datetime"], bucket, x, "cum").select(c_("i").alias("at"), "cum")
    grid = series.sparkSession.range(draws).withColumnRenamed("id", "d").transform(scalars(one)).where(c_("n") >= block)
    grid = grid.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(c_("n") / F.lit(block)).cast("int") - 1)))
    grid = grid.withColumn("start", F.floor(hash_uniform(seed, "d", "b") * c_("n")).cast("long"))
    grid = grid.withColumn("stop", F.least(c_("start") + block, c_("n")))
    ends = grid.join(cum.select((c_("at") + 1).alias("stop"), c_("cum").alias("_hi")), "stop", "inner")
    ends = ends.join(cum.select((c_("at") + 1).alias("start"), c_("cum").alias("_lo")), "start", "left")
    means = ends.groupBy("d").agg((F.sum(c_("_hi") - F.coalesce(c_("_lo"), F.lit(0.0))) / F.sum(c_("stop") - c_("start"))).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return one.transform(scalars(q)).select("n", c_("q")[0].alias("lo"), c_("q")[1].alias("hi"))


def evaluation_bundle(df: DataFrame, g: Groups, p: str, y: str = "label", min_symbols: int = 8, stride: int = 30,
                      sectors: bool = True) -> dict[str, DataFrame]:
    """All series, their summaries, and the monthly, session and sector tables."""
    d = views.pred_variants(df, g, p)
    spec = {"dense_cs_ic": ("pred_cs_zscore", False, 1), "dense_cs_rankic": ("pred_cs_zscore", True, 1),
            "nonoverlap_raw_cs_ic": ("pred_cs_zscore", False, stride),
            "nonoverlap_sector_neutral_cs_ic": ("pred_sector_neutral_zscore", False, stride),
            "nonoverlap_sector_neutral_cs_rankic": ("pred_sector_neutral_zscore", True, stride)}
    tables = {n: ic_series(d, g, v, y, min_symbols, r, s) for n, (v, r, s) in spec.items()}
    metrics = None
    for n in spec:
        row = summarise_series(tables[n]).withColumn("metric", F.lit(n))
        metrics = row if metrics is None else metrics.unionByName(row)
    tables["metrics"] = metrics
    sn = tables["nonoverlap_sector_neutral_cs_ic"]
    tables["monthly"] = summarise_series(sn, ["month"])
    tables["session"] = summarise_series(sn, ["session_type"])
    if not sectors:
        return tables
    # z values that agree up to rounding are ties, not an order
    d = d.withColumn("_snz", F.round("pred_sector_neutral_zscore", 9))
    tables["sector"] = merged_ic(d, "pred_sector_neutral_zscore", y, ["sector"]).join(
        rank_ic(d, "_snz", y, ["sector"]).select("sector", "rank_ic"), "sector", "left")
    return tables


def cross_section_summary(df: DataFrame, g: Groups, p: str, y: str = "label", min_count: int = 8) -> DataFrame:
    s = ic_series(df, g, p, y, min_count, score="ic")
    return s.agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ir"),
                 F.avg((c_("ic") > 0).cast("double")).alias("positive_frac"), F.count("ic").alias("n"))


def bin_returns(df: DataFrame, g: Groups, p: str, y: str = "label", bins: int = 20) -> DataFrame:
    """Mean label by rank bin inside each timestamp; ties broken by a hash of the symbol."""
    d = df.where(both(p, y)).withColumn("_u", hash_uniform(0, "symbol"))
    if g.fits:
        w = Window.partitionBy(*g.keys)
        d = d.withColumn("_s", F.row_number().over(w.orderBy(p, "_u", "symbol")) / F.count(F.lit(1)).over(w))
    else:
        vc = xsec.value_counts(d, g.keys, p)
        d = with_ordinal(d, [*g.keys, p], ["_u", "symbol"], hash_slice("_u"), "_t")
        d = d.join(vc, [*g.keys, p], "inner").withColumn("_s", (c_("_below") + c_("_t") + 1) / c_("_n"))
    b = F.least(F.floor(c_("_s") * bins), F.lit(bins - 1)) + 1
    return d.groupBy(b.cast("long").alias("bin")).agg(F.avg(y).alias("mean_return"), F.count(F.lit(1)).alias("rows"))


def quantile_bins(df: DataFrame, p: str, y: str = "label", bins: int = 30) -> DataFrame:
    """Mean prediction and label per prediction quantile, duplicate edges dropped."""
    d = df.where(both(p, y))
    e = xsec.edges(d, p, [i / bins for i in range(bins + 1)], distinct=True)
    # right-closed intervals; the smallest value belongs to the first
    b = F.greatest(edges_below(p, e), F.lit(1))
    return (d.groupBy(b.cast("long").alias("bin"))
            .agg(F.avg(p).alias("pred"), F.avg(y).alias("label"), F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, x: str, bins: int = 100) -> DataFrame:
    d = df.where(c_(x).isNotNull())
    one = d.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    b = F.least(F.floor((c_(x) - c_("_lo")) / F.greatest(c_("_hi") - c_("_lo"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("long")
    return (d.transform(scalars(one)).groupBy(b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (c_("_lo") + (c_("_hi") - c_("_lo")) * c_("bin") / bins).alias("left_edge"), "n"))


def weekly_cumulative(df: DataFrame, p: str, y: str = "label") -> DataFrame:
    """Weekly IC and its running sum (weeks: a calendar-bounded table)."""
    wk = ic_by_period(df, p, y, F.date_format(F.date_trunc("week", "datetime"), "yyyy-MM-dd"), "week")
    return wk.withColumn("cum_ic", F.sum("ic").over(Window.partitionBy(F.lit(0)).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)))


def xsz_ic(df: DataFrame, g: Groups, cols: Sequence[str], y: str = "label", eps: float = 1e-9) -> DataFrame:
    """IC of the per-timestamp z of many columns at once: one pass, then one row per column."""
    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    for x in cols:
        aggs[f"_m_{x}"], aggs[f"_s_{x}"] = F.avg(x), F.stddev_samp(x)
    d = xsec.with_stats(df, g, aggs).where(c_("_n") >= 2)
    sums = []
    for x in cols:
        z = F.when(c_(f"_s_{x}") > 1e-12, (c_(x) - c_(f"_m_{x}")) / (c_(f"_s_{x}") + F.lit(eps)))
        z = F.when(c_(y).isNotNull(), z)
        sums += [F.sum(z * c_(y)).alias(f"xy_{x}"), F.sum(z * z).alias(f"xx_{x}")]
    one = d.agg(*sums, F.sum(c_(y) * c_(y)).alias("yy"))
    rows = F.array(*[F.struct(F.lit(x).alias("factor"), (c_(f"xy_{x}") / F.sqrt(F.greatest(c_(f"xx_{x}") * c_("yy"), F.lit(1e-30)))).alias("ic")) for x in cols])
    return one.select(F.inline(rows))


def align_external(base: DataFrame, ext: DataFrame) -> DataFrame:
    """External predictions on the base grid; a key must be unique in ``ext``, missing becomes 0."""
    one = ext.groupBy("symbol", "datetime").agg(F.max("pred").alias("_p"), F.count(F.lit(1)).alias("_k"))
    pred = F.when(~F.isnan("_p") & (F.abs("_p") < F.lit(float("inf"))), c_("_p"))
    return (base.select("symbol", "datetime", "label").join(one, ["symbol", "datetime"], "left")
            .withColumns({"pred": F.when(c_("_k") > 1, F.raise_error(F.lit("duplicate prediction key"))).otherwise(F.coalesce(pred, F.lit(0.0))),
                          "missing": pred.isNull()}).drop("_p", "_k"))


def audit(aligned: DataFrame) -> DataFrame:
    s = ic_summary(aligned, "pred")
    miss = aligned.agg(F.sum(c_("missing").cast("long")).alias("missing_filled"), F.count(F.lit(1)).alias("rows"))
    return s.drop("coverage", "n").transform(scalars(miss))


def keep_gate(metrics: DataFrame, baseline: str, a: str, b: str) -> DataFrame:
    """Keep a candidate only if both metrics rise over the baseline row."""
    base = metrics.where(c_("name") == baseline).select(c_(a).alias("_a"), c_(b).alias("_b"))
    return (metrics.where(c_("name") != baseline).transform(scalars(base))
            .withColumn("decision", F.when((c_(a) > c_("_a")) & (c_(b) > c_("_b")), F.lit("keep")).otherwise(F.lit("reject")))
            .drop("_a", "_b"))


def huber(df: DataFrame, pairs: Sequence[tuple[str, str, str, float]], delta: float = 1.0) -> DataFrame:
    """Masked, weighted Huber loss over several targets: (pred, target, mask, weight)."""
    num, den = F.lit(0.0), F.lit(0.0)
    for p, y, m, w in pairs:
        e = F.abs(c_(p) - c_(y))
        loss = F.when(e <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (e - F.lit(0.5 * delta)))
        on = F.when(c_(m), F.lit(float(w))).otherwise(0.0)
        num, den = num + F.coalesce(loss * on, F.lit(0.0)), den + on
    return df.agg((F.sum(num) / F.greatest(F.sum(den), F.lit(1.0))).alias("huber"))


def tail_mse(df: DataFrame, p: str, y: str, tail: float) -> DataFrame:
    """Mean of the largest ``ceil(tail * n)`` squared errors, without sorting rows in one task."""
    e = df.where(both(p, y)).select(((c_(p) - c_(y)) * (c_(p) - c_(y))).alias("e"))
    vc = xsec.value_counts(e, [], "e")
    k = F.greatest(F.ceil(F.lit(tail) * c_("_n")), F.lit(1))
    # rows of a value that are among the k largest
    take = F.greatest(F.least(c_("_c"), k - (c_("_n") - c_("_below") - c_("_c"))), F.lit(0))
    return vc.agg((F.sum(take * c_("e")) / F.sum(take)).alias("tail_mse"))


def group_losses(df: DataFrame, p: str, y: str, min_size: int = 8) -> DataFrame:
    """Per-timestamp standardised, centred and mean-error losses from moments, averaged over timestamps."""
    m = df.where(both(p, y)).groupBy("datetime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.var_pop(p).alias("vp"), F.var_pop(y).alias("vy"),
        F.covar_pop(p, y).alias("c")).where(c_("n") >= min_size)
    sp, sy = F.sqrt("vp") + F.lit(1e-8), F.sqrt("vy") + F.lit(1e-8)
    std = c_("vp") / (sp * sp) + c_("vy") / (sy * sy) - F.lit(2.0) * c_("c") / (sp * sy)
    return m.agg(F.avg(std).alias("standardised_mse"), F.avg(c_("vp") + c_("vy") - F.lit(2.0) * c_("c")).alias("centred_mse"),
                 F.avg((c_("mp") - c_("my")) * (c_("mp") - c_("my"))).alias("mean_mse"))
