"""Calibration: multipliers and lines per key, shifts, scales, and the choice among candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import clip, edges_at_or_below, minute_of_day
from barwright.plans import xsec
from barwright.plans.rolling_quantiles import rolling_quantiles
from barwright.plans.staging import stage
from barwright.plans.xsec import scalars

c_ = F.col


# ---- keys ---------------------------------------------------------------------------------------
def time_key(minutes: int) -> Column:
    return F.floor(minute_of_day("datetime") / minutes).cast("long")


def with_bins(df: DataFrame, x: Column, train: Column, bins: int, out: str, probs: Sequence[float] | None = None) -> DataFrame:
    """Bin by train quantiles: number of distinct edges at or below the value."""
    p = list(probs) if probs else [i / bins for i in range(1, bins)]
    return df.withColumn(out, edges_at_or_below(x, xsec.edges(df.where(train), x, p, distinct=True)))


def abs_key(df: DataFrame, p: str, train: Column, bins: int, out: str, signed: bool = False) -> DataFrame:
    d = with_bins(df, F.abs(p), train, bins, out)
    return d.withColumn(out, c_(out) * 2 + (c_(p) >= 0).cast("long")) if signed else d


def month_number(month: str) -> Column:
    """Months since year 0 of a yyyy-MM text."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def strength_key(xrank: str, bins: int) -> Column:
    return F.least(F.floor(F.abs(F.coalesce(c_(xrank), F.lit(0.0))) * bins), F.lit(bins - 1)).cast("long")


# ---- multipliers --------------------------------------------------------------------------------
def fit_multiplier(train: DataFrame, key: str, p: str, y: str = "label", k: float = 1000.0, alpha: float = 0.5, lo: float = 0.5,
                   hi: float = 1.5, min_count: int = 0) -> DataFrame:
    """Slope of a key over the common slope, clipped, shrunk by reliability n / (n + k)."""
    per = train.groupBy(key).agg(F.sum(c_(p) * c_(y)).alias("xy"), F.sum(c_(p) * c_(p)).alias("xx"), F.count(F.lit(1)).alias("n"))
    one = per.agg((F.sum("xy") / F.greatest(F.sum("xx"), F.lit(1e-30))).alias("_g"))
    raw = clip((c_("xy") / F.greatest(c_("xx"), F.lit(1e-30))) / c_("_g"), lo, hi)
    rel = F.when(c_("n") >= min_count, c_("n") / (c_("n") + F.lit(float(k)))).otherwise(0.0)
    return (per.transform(scalars(one))
            .select(key, "n", F.when(F.abs("_g") < 1e-30, F.lit(1.0)).otherwise(F.lit(1.0) + F.lit(alpha) * rel * (raw - 1)).alias("mult")))


def apply_multiplier(df: DataFrame, table: DataFrame, key: str, p: str, out: str) -> DataFrame:
    d = df.join(table.select(key, c_("mult").alias("_mult")), key, "left")
    return d.withColumn(out, c_(p) * F.coalesce(c_("_mult"), F.lit(1.0))).drop("_mult")


def sequential(df: DataFrame, train: Column, p: str, stages: Sequence[tuple[str, int]], out: str = "pred_cal", k: float = 1000.0,
               alpha: float = 0.5) -> DataFrame:
    """Stages refit on the already calibrated prediction; kinds time / abs / signed_abs."""
    d = df.withColumn(out, c_(p))
    for kind, size in stages:
        if kind == "time":
            d = d.withColumn("_key", time_key(size))
        else:
            d = abs_key(d, out, train, size, "_key", kind == "signed_abs")
        d = apply_multiplier(d, fit_multiplier(d.where(train), "_key", out, k=k, alpha=alpha), "_key", out, out).drop("_key")
    return d


# ---- lines --------------------------------------------------------------------------------------
def _sums(x: str, y: str) -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
            F.sum(c_(x) * c_(x)).alias("sxx"), F.sum(c_(x) * c_(y)).alias("sxy")]


def _centred(d: DataFrame) -> DataFrame:
    """Means, variance and covariance from additive sums."""
    d = d.withColumns({"mx": c_("sx") / c_("n"), "my": c_("sy") / c_("n")})
    return d.withColumns({"vx": c_("sxx") / c_("n") - c_("mx") * c_("mx"), "cxy": c_("sxy") / c_("n") - c_("mx") * c_("my")})


def _line(sums: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """The line of all rows, ``gs`` and ``gi``, and their variance ``gv``; the identity where rows are few or x is constant."""
    g = _centred(sums)
    enough, spread = c_("n") >= min_rows, c_("vx") * c_("n") > 1e-12
    g = g.withColumn("gs", F.when(enough & spread, F.try_divide("cxy", "vx")).otherwise(F.lit(1.0)))
    return g.select(*keys, "gs", F.when(enough, c_("my") - c_("gs") * c_("mx")).otherwise(F.lit(0.0)).alias("gi"),
                    F.when(enough, F.greatest(c_("vx"), F.lit(1e-12))).otherwise(F.lit(1.0)).alias("gv"))


def _shrunk(per: DataFrame, slope_shrink: float, intercept_shrink: float, min_rows: int, lo: float, hi: float) -> DataFrame:
    """Lines per key, drawn towards the line of all rows as if it had been seen on that many further rows; few rows take it as it is."""
    d = _centred(per).withColumn("pull", F.lit(slope_shrink) * c_("gv") / c_("n"))
    own = F.try_divide(c_("cxy") + c_("pull") * c_("gs"), c_("vx") + c_("pull"))
    d = d.withColumn("line", clip(F.coalesce(own, c_("gs")), lo, hi))
    share = c_("n") / (c_("n") + F.lit(intercept_shrink))
    level = share * (c_("my") - c_("line") * c_("mx")) + (F.lit(1.0) - share) * c_("gi")
    known = c_("n") >= min_rows
    d = d.withColumns({"slope": F.when(known, c_("line")).otherwise(c_("gs")), "icpt": F.when(known, level).otherwise(c_("gi"))})
    return d.drop("pull", "line", "mx", "my", "vx", "cxy")


def rolling_key_affine(df: DataFrame, keys: Sequence[str], x: str, y: str = "label", month: str = "month", lookback: int = 18,
                       slope_shrink: float = 400.0, intercept_shrink: float = 300.0, min_rows: int = 0, min_train: int = 5000,
                       lo: float = 0.5, hi: float = 1.5, output: str = "score", out: str = "pred_cal") -> DataFrame:
    """A shrunk line per key and month, from the months before it.

    Rows are summed by (month, key) once; every month's sums are then handed to the months that
    may look back at it, so the panel is never replicated.
    """
    d = df.withColumn("_t", month_number(month))
    cells = d.where(c_(x).isNotNull() & c_(y).isNotNull()).groupBy("_t", *keys).agg(*_sums(x, y))
    ahead = cells.withColumn("_t", F.explode(F.sequence(c_("_t") + 1, c_("_t") + lookback)))
    return _affine(d, ahead, keys, x, slope_shrink, intercept_shrink, min_rows, min_train, lo, hi, output, out).drop("_t")


def _affine(d: DataFrame, ahead: DataFrame, keys: Sequence[str], x: str, slope_shrink: float, intercept_shrink: float, min_rows: int,
            min_train: int, lo: float, hi: float, output: str, out: str) -> DataFrame:
    """Lines from sums already handed to the times ``_t`` that look back at them, applied to the rows of those times."""
    add = [F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "sxy")]
    per = ahead.groupBy("_t", *keys).agg(*add)
    whole = _line(per.groupBy("_t").agg(*add).where(c_("n") >= min_train), ["_t"], 0)
    table = _shrunk(per.join(whole, "_t"), slope_shrink, intercept_shrink, min_rows, lo, hi).select("_t", *keys, "slope", "icpt")
    j = d.join(whole, "_t", "left").join(table, ["_t", *keys], "left")
    hat = F.coalesce(c_("slope"), c_("gs")) * c_(x) + F.coalesce(c_("icpt"), c_("gi"))
    val = F.when(F.abs("gs") > 1e-12, F.try_divide(hat - c_("gi"), c_("gs"))).otherwise(hat) if output == "score" else hat
    return j.withColumn(out, F.when(c_("gs").isNull(), c_(x)).otherwise(val)).drop("gs", "gi", "gv", "slope", "icpt")


BINNED = ("conf", "range", "vol", "ret")


def bin_source(kind: str, p: str) -> Column:
    """What a binned token cuts: the size of the prediction, or the state of the market at the bar."""
    return {"conf": F.abs(p), "range": c_("state_range"), "vol": c_("state_logvol"), "ret": F.abs("state_ret1")}[kind]


def composite_keys(df: DataFrame, parts: Sequence[str], p: str, train: Column) -> tuple[DataFrame, list[str]]:
    """Key columns from tokens: symbol, group, hour, tod4, sign, confN, rangeN, volN, retN."""
    cols: list[str] = []
    m = minute_of_day("datetime")
    for part in parts:
        name = f"{part}_key"
        if part == "symbol":
            cols.append("symbol")
            continue
        if part == "group":
            df = df.withColumn(name, F.coalesce("grp", F.lit("other")))
        elif part == "hour":
            df = df.withColumn(name, F.hour("datetime").cast("long"))
        elif part == "tod4":
            df = df.withColumn(name, F.when(m <= 600, 0).when(m <= 720, 1).when(m <= 840, 2).otherwise(3).cast("long"))
        elif part == "sign":
            df = df.withColumn(name, F.signum(p).cast("long"))
        else:
            kind = part.rstrip("0123456789")
            df = with_bins(df, bin_source(kind, p), train, int(part[len(kind):]), name).withColumn(name, F.coalesce(name, F.lit(0)))
        cols.append(name)
    return df, cols


def rolling_edges(df: DataFrame, parts: Sequence[str], p: str, time: str, lookback: int, least: int = 1000) -> DataFrame:
    """One row per time with an array of distinct edges for each binned part, cut from the rows of the ``lookback`` times before.

    A window with fewer than ``max(least, 100 * bins)`` finite values has no edges.
    """
    bins = {q: int(q[len(q.rstrip("0123456789")):]) for q in parts}
    tall = F.inline(F.array(*[F.struct(F.lit(q).alias("part"), bin_source(q.rstrip("0123456789"), p).cast("double").alias("x")) for q in bins]))
    edges = rolling_quantiles(df.select(c_(time).alias("time"), tall), lookback, {q: [k / n for k in range(1, n)] for q, n in bins.items()})
    need = F.element_at(F.create_map(*[F.lit(v) for q, n in bins.items() for v in (q, max(least, 100 * n))]), c_("part"))
    kept = edges.where(c_("n") >= need).withColumn("edges", F.array_sort(F.array_distinct("edges")))
    return kept.groupBy(c_("time").alias(time)).agg(*[F.first(F.when(c_("part") == q, c_("edges")), ignorenulls=True).alias(f"_e_{q}") for q in bins])


def _passed_edges(edges: str, x: Column) -> Column:
    """Number of edges at or below x; 0 where x or the edges are missing."""
    known = F.when(~F.isnan(x), x)
    return F.when(known.isNotNull() & c_(edges).isNotNull(), F.size(F.filter(edges, lambda e: e <= known))).otherwise(0).cast("long")


def _last_cut(cuts: str, x: Column) -> Column:
    """The largest cut at or below x."""
    known = F.when(~F.isnan(x), x)
    return F.array_max(F.filter(cuts, lambda e: e <= known))


def _split_parts(parts: Sequence[str]) -> tuple[list[str], list[str]]:
    binned = [q for q in parts if q.rstrip("0123456789") in BINNED and q[-1].isdigit()]
    return [q for q in parts if q not in binned], binned


def rolling_keys(df: DataFrame, parts: Sequence[str], p: str, time: str, lookback: int = 18, least: int = 1000) -> tuple[DataFrame, list[str]]:
    """Key columns as ``composite_keys`` makes them, but with the edges of each time's own look-back.

    ``time`` is an integer column (months, days). The table of edges has one row per time; missing and not-a-number values fall into key 0.
    """
    plain, binned = _split_parts(parts)
    df, cols = composite_keys(df, plain, p, F.lit(True))
    if binned:
        df = df.join(rolling_edges(df, binned, p, time, lookback, least), time, "left")
        df = df.withColumns({f"{q}_key": _passed_edges(f"_e_{q}", bin_source(q.rstrip("0123456789"), p)) for q in binned}).drop(*[f"_e_{q}" for q in binned])
    return df, ["symbol" if q == "symbol" else f"{q}_key" for q in parts]


def rolling_bucket_affine(df: DataFrame, parts: Sequence[str], p: str, y: str = "label", time: str = "month_no", lookback: int = 18,
                          least: int = 1000, slope_shrink: float = 400.0, intercept_shrink: float = 300.0, min_rows: int = 0,
                          min_train: int = 5000, lo: float = 0.5, hi: float = 1.5, output: str = "score", out: str = "pred_cal") -> DataFrame:
    """A shrunk line per composite key and time, where the bins of a key are cut anew at every time.

    A past row's key depends on the time that looks back at it. Rows are therefore summed by the last cut of any time at or
    below their value: that cut stands for the row under every time's edges, so sums, not rows, go to the times that use them.
    """
    plain, binned = _split_parts(parts)
    d, _ = composite_keys(df, plain, p, F.lit(True))
    names = ["symbol" if q == "symbol" else f"{q}_key" for q in parts]
    fixed = [n for q, n in zip(parts, names) if q in plain]
    edges = stage(rolling_edges(d, binned, p, time, lookback, least), "rolling-edges")
    cuts = edges.agg(*[F.array_distinct(F.flatten(F.collect_list(f"_e_{q}"))).alias(f"_c_{q}") for q in binned])  # times x bins values
    source = {q: bin_source(q.rstrip("0123456789"), p).cast("double") for q in binned}
    snap = {f"_s_{q}": _last_cut(f"_c_{q}", source[q]) for q in binned}
    rows = d.where(c_(p).isNotNull() & c_(y).isNotNull()).transform(scalars(cuts)).withColumns(snap)
    cells = rows.groupBy(c_(time).alias("_t"), *fixed, *snap).agg(*_sums(p, y))
    ahead = cells.withColumn("_t", F.explode(F.sequence(c_("_t") + 1, c_("_t") + lookback))).join(edges.withColumnRenamed(time, "_t"), "_t", "left")
    ahead = ahead.withColumns({f"{q}_key": _passed_edges(f"_e_{q}", c_(f"_s_{q}")) for q in binned})
    d = d.join(edges, time, "left").withColumns({f"{q}_key": _passed_edges(f"_e_{q}", source[q]) for q in binned} | {"_t": c_(time)})
    d = d.drop(*[f"_e_{q}" for q in binned])
    return _affine(d, ahead, names, p, slope_shrink, intercept_shrink, min_rows, min_train, lo, hi, output, out).drop("_t")


def group_time_affine(df: DataFrame, train: Column, group: str, p: str, y: str = "label", k: float = 100_000.0, min_rows: int = 25_000,
                      lo: float = 0.35, hi: float = 1.85, out: str = "pred_cal") -> DataFrame:
    """A line per group and part of the day mixed with the global slope by n / (n + k)."""
    m = minute_of_day("datetime")
    d = df.withColumn("_tb", F.when(m <= 615, 0).when(m <= 765, 1).when(m <= 900, 2).otherwise(3))
    per = d.where(train & c_(p).isNotNull() & c_(y).isNotNull()).groupBy(group, "_tb").agg(*_sums(p, y))
    one = _line(per.agg(*[F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "sxy")]), [], 0)
    vxx = c_("sxx") - c_("sx") * c_("sx") / c_("n")
    own = F.try_divide(c_("sxy") - c_("sx") * c_("sy") / c_("n"), vxx)
    a = c_("n") / (c_("n") + F.lit(float(k)))
    t = per.where(c_("n") >= min_rows).transform(scalars(one)).withColumns({"_own": own, "_a": a})
    t = t.select(group, "_tb", ((F.lit(1.0) - c_("_a")) * c_("gs") + c_("_a") * clip("_own", lo, hi)).alias("_s"),
                 (c_("_a") * F.lit(0.35) * (c_("sy") / c_("n") - c_("_own") * c_("sx") / c_("n"))).alias("_i"))
    j = d.join(t, [group, "_tb"], "left").transform(scalars(one.select("gs")))
    return j.withColumn(out, F.coalesce(c_("_s"), c_("gs")) * c_(p) + F.coalesce(c_("_i"), F.lit(0.0))).drop("_tb", "_s", "_i", "gs")


# ---- scales and shifts --------------------------------------------------------------------------
def bucket_scales(df: DataFrame, train: Column, key: str, p: str, y: str = "label", penalty: float = 0.01, lo: float = 0.7, hi: float = 1.3,
                  min_rows: int = 0, steps: int = 200, out: str = "pred_cal") -> DataFrame:
    """Bucket scales that raise the IC less a penalty on (s - 1)^2, inside bounds; all 1 with fewer than ``min_rows`` train rows.

    At the optimum each bucket's scale follows from two numbers alone, the gain of the blend's covariance and the price of its
    size: s = (gain * a + 2 * penalty * w) / (price * b + 2 * penalty * w), clipped. So a step is one aggregate over the table of
    buckets, which also judges shorter and longer steps, and no task ever holds that table.
    """
    rows = df.where(train & c_(key).isNotNull() & c_(p).isNotNull() & c_(y).isNotNull())
    per = stage(rows.groupBy(key).agg(F.sum(c_(p) * c_(y)).alias("a"), F.sum(c_(p) * c_(p)).alias("b"), F.count(F.lit(1)).cast("double").alias("n"),
                                      F.sum(c_(y) * c_(y)).alias("yy")), "buckets")
    n, yy, num, q = per.agg(F.sum("n"), F.sum("yy"), F.sum("a"), F.sum("b")).head()
    if not n or n < min_rows or not yy or not q:
        return df.withColumn("scale", F.lit(1.0)).withColumn(out, c_(p))
    pull = F.lit(2.0 * penalty / n) * c_("n")

    def scale(gain: float, price: float) -> Column:
        up, curve = F.lit(gain) * c_("a") + pull, F.lit(price) * c_("b") + pull
        # without curvature, or with the wrong one (a blend of negative covariance), the better bound
        end = F.when((up == 0) & (curve == 0), F.lit(1.0)).when(up > curve * F.lit((lo + hi) / 2), F.lit(float(hi))).otherwise(F.lit(float(lo)))
        return F.when(curve > 0, clip(up / curve, lo, hi)).otherwise(end)

    def rate(num: float, q: float) -> tuple[float, float]:
        den = (q * yy) ** 0.5
        return 1.0 / den, num / (den * q)

    def judge(tries: Sequence[tuple[float, float]]) -> list[tuple[float, float, float]]:
        sums = []
        for at in tries:
            s = scale(*at)
            sums += [F.sum(s * c_("a")), F.sum(s * s * c_("b")), F.sum(pull / 2 * (s - 1) * (s - 1))]
        v = per.agg(*sums).head()
        return [(v[k] / (v[k + 1] * yy) ** 0.5 - v[k + 2], v[k], v[k + 1]) if v[k + 1] else (float("-inf"), 0.0, 0.0) for k in range(0, len(v), 3)]

    at = rate(num, q)
    (best, num, q), = judge([at])
    for _ in range(steps):
        to = rate(num, q)
        if max(abs(u - v) / max(abs(v), 1e-300) for u, v in zip(to, at)) < 1e-10:
            break
        # the step itself, shorter and longer ones, judged by one aggregate; a blend against the label has many local optima, so no longer ones
        reach = (1.0, 0.0625, 0.25, 0.5) + ((2.0, 4.0, 8.0, 16.0, 32.0) if to[1] > 0 else ())
        tries = [(at[0] + f * (to[0] - at[0]), at[1] + f * (to[1] - at[1])) for f in reach]
        seen = judge(tries)
        k = 0 if to[1] <= 0 and seen[0][0] >= best - 1e-15 else max(range(len(seen)), key=lambda j: seen[j][0])
        if seen[k][0] < best - 1e-15:
            break
        at, (best, num, q) = tries[k], seen[k]
    d = df.join(per.select(key, scale(*at).alias("scale")), key, "left")
    return d.withColumn(out, c_(p) * F.coalesce("scale", F.lit(1.0)))


def shift_grid(df: DataFrame, val: Column, p: str, y: str = "label", lo: float = -3.0, hi: float = 3.0, steps: int = 49) -> DataFrame:
    """IC of p - c * |mean| for every c of a grid, from five sums."""
    s = df.where(val & c_(p).isNotNull() & c_(y).isNotNull()).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(c_(p) * c_(p)).alias("pp"),
        F.sum(c_(p) * c_(y)).alias("py"), F.sum(c_(y) * c_(y)).alias("yy"), F.stddev_pop(p).alias("sd"))
    basis = F.when(F.abs(c_("sp") / c_("n")) >= 1e-12, F.abs(c_("sp") / c_("n"))).otherwise(c_("sd"))
    g = s.withColumn("_b", basis).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    g = g.withColumn("coef", F.lit(lo) + F.lit((hi - lo) / (steps - 1)) * c_("step")).withColumn("shift", c_("coef") * c_("_b"))
    q = c_("pp") - F.lit(2.0) * c_("shift") * c_("sp") + c_("n") * c_("shift") * c_("shift")
    return g.select("step", "coef", "shift", ((c_("py") - c_("shift") * c_("sy")) / F.sqrt(q * c_("yy"))).alias("ic"))


def shifted(df: DataFrame, val: Column, p: str, mode: str, y: str = "label", shrink: float = 1.0, out: str = "pred_cal") -> DataFrame:
    """Subtract a mean, a median or the best grid shift of the validation rows."""
    if mode == "ic_grid":
        one = shift_grid(df, val, p, y).agg(F.max_by("shift", F.struct("ic", -c_("step"))).alias("_shift"))
    elif mode == "median":
        return df.withColumn(out, c_(p) - F.lit(shrink * (xsec.edges(df.where(val), p, [0.5]) or [0.0])[0]))
    else:
        one = df.where(val).agg((F.lit(shrink) * F.avg(p)).alias("_shift"))
    return df.transform(scalars(one)).withColumn(out, c_(p) - c_("_shift")).drop("_shift")


def aux_scale(df: DataFrame, main: str, aux: Sequence[str], train: Column, lo: float = 0.25, hi: float = 4.0, power: float = 1.0,
              g: xsec.Groups | None = None, out: str = "pred_cal") -> DataFrame:
    """Scale by mean(max(aux, 0) / |train mean|), clipped and raised; averaged per timestamp if groups are given."""
    one = df.where(train).agg(*[F.greatest(F.abs(F.avg(a)), F.lit(1e-8)).alias(f"_m_{a}") for a in aux])
    rel = sum((F.greatest(c_(a), F.lit(0.0)) / c_(f"_m_{a}") for a in aux), F.lit(0.0)) / F.lit(float(len(aux)))
    d = df.transform(scalars(one)).withColumn("_s", F.pow(clip(F.coalesce(rel, F.lit(1.0)), lo, hi), F.lit(power)))
    if g is not None:
        d = xsec.with_stats(d, g, {"_sg": F.avg("_s")}).withColumn("_s", c_("_sg")).drop("_sg")
    return d.withColumn(out, c_(main) * c_("_s")).drop("_s", *[f"_m_{a}" for a in aux])


# ---- screening ----------------------------------------------------------------------------------
def month_scores(df: DataFrame, preds: Sequence[str], y: str = "label", month: str = "month") -> DataFrame:
    """(month, candidate, xy, xx, yy, ic) from one pass over the rows."""
    sums = [e for p in preds for e in (F.sum(c_(p) * c_(y)).alias(f"a_{p}"), F.sum(c_(p) * c_(p)).alias(f"b_{p}"))]
    wide = df.where(c_(y).isNotNull()).groupBy(month).agg(F.sum(c_(y) * c_(y)).alias("yy"), *sums)
    rows = F.array(*[F.struct(F.lit(p).alias("candidate"), c_(f"a_{p}").alias("xy"), c_(f"b_{p}").alias("xx"), c_("yy").alias("yy")) for p in preds])
    return wide.select(month, F.inline(rows)).withColumn("ic", F.try_divide(c_("xy"), F.sqrt(c_("xx") * c_("yy"))))


def selectors(scores: DataFrame, lam: float = 0.5, fold: str = "fold") -> DataFrame:
    """Mean - lambda * deviation, mix of minimum and mean, and recency-weighted scores per candidate."""
    k = F.row_number().over(Window.partitionBy("candidate").orderBy(fold))  # a handful of folds
    s = scores.withColumn("_k", k.cast("double"))
    return s.groupBy("candidate").agg(
        F.avg("ic").alias("mean_ic"), F.min("ic").alias("min_ic"), F.stddev_samp("ic").alias("std_ic"),
        (F.avg("ic") - F.lit(lam) * F.coalesce(F.stddev_samp("ic"), F.lit(0.0))).alias("mean_std"),
        (F.lit(0.5) * F.min("ic") + F.lit(0.5) * F.avg("ic")).alias("min_mean"), (F.sum(c_("_k") * c_("ic")) / F.sum("_k")).alias("recent"))


def winners(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best candidate under each selector; ties go to the first name."""
    rows = table.select("candidate", F.inline(F.array(*[F.struct(F.lit(s).alias("selector"), c_(s).alias("score")) for s in by])))
    w = Window.partitionBy("selector").orderBy(F.desc("score"), "candidate")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
