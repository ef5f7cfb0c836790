"""Regime memory tables, guards and rule tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.operators import calibrate, evaluate, relational
from barwright.plans.xsec import scalars

c_ = F.col


def regime_memory(df: DataFrame, train: Column, features: Sequence[str], quantiles: Sequence[float], bucket_minutes: int = 60, min_count: int = 50,
                  shrink: float = 100.0, half_life_days: float | None = None, y: str = "label", out: str = "memory") -> DataFrame:
    """Shrunk mean label over seven key sets, tried from the finest to the coarsest.

    All seven tables come from one GROUPING SETS aggregate over the train rows.
    """
    d = df.withColumn("_tb", calibrate.time_key(bucket_minutes))
    for f in features:
        d = calibrate.with_bins(d, F.coalesce(c_(f), F.lit(0.0)), train, 0, f"_bin_{f}", quantiles)
    bins = [f"_bin_{f}" for f in features]
    sets = [["symbol", "_tb", *bins], ["symbol", *bins], ["_tb", *bins], bins, ["symbol", "_tb"], ["symbol"], ["_tb"]]
    src = d.where(train & c_(y).isNotNull())
    if half_life_days:
        last = src.agg(F.max("datetime").alias("_last"))
        age = F.timestamp_diff("SECOND", c_("datetime"), c_("_last")) / F.lit(86400.0)
        src = src.transform(scalars(last)).withColumn("_w", F.greatest(F.pow(F.lit(0.5), age / F.lit(half_life_days)), F.lit(1e-6)))
    else:
        src = src.withColumn("_w", F.lit(1.0))
    keys = ["symbol", "_tb", *bins]
    agg = src.groupingSets([[c_(k) for k in s] for s in (*sets, [])], *[c_(k) for k in keys]).agg(
        F.sum(c_("_w") * c_(y)).alias("_wy"), F.sum("_w").alias("_ws"), F.count(y).alias("_n"), F.grouping_id().alias("_gid"))
    gid = lambda s: sum(0 if k in s else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
    mean = agg.where(c_("_gid") == gid([])).select((c_("_wy") / c_("_ws")).alias("_global"))
    tables = []
    for s in sets:
        t = agg.where((c_("_gid") == gid(s)) & (c_("_n") >= min_count)).transform(scalars(mean))
        tables.append((t.select(*s, ((c_("_wy") + F.lit(shrink) * c_("_global")) / (c_("_ws") + F.lit(shrink))).alias("_mem")), s))
    d = relational.lookup_chain(d.transform(scalars(mean)), tables, "_mem", out, float("nan"))
    return d.withColumn(out, F.when(F.isnan(out), c_("_global")).otherwise(c_(out))).drop("_tb", "_global", *bins)


def group_deltas(df: DataFrame, group: str, current: str, candidate: str, y: str = "label") -> DataFrame:
    """IC of both predictions per group and their difference."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), evaluate.ic(current, y).alias("cur"), evaluate.ic(candidate, y).alias("cand")).where(
        "n >= 2 and cur is not null and cand is not null").withColumn("delta", c_("cand") - c_("cur"))


def stability(df: DataFrame, group: str, current: str, candidate: str, y: str = "label", min_positive: int = 1, max_decline: float = -1e9,
              min_last: float = -1e9) -> DataFrame:
    """Groups that gain, the worst and the last change, and the verdict."""
    s = group_deltas(df, group, current, candidate, y).agg(
        F.sum((c_("delta") > 0).cast("long")).alias("positive_groups"), F.count(F.lit(1)).alias("n_groups"), F.min("delta").alias("min_delta"),
        F.max_by("delta", group).alias("last_delta"))
    return s.withColumn("passes", (c_("n_groups") > 0) & (c_("positive_groups") >= F.least(F.lit(min_positive), c_("n_groups")))
                        & (c_("min_delta") >= max_decline) & (c_("last_delta") >= min_last))


def symbol_sums(df: DataFrame, p: str, y: str = "label") -> DataFrame:
    return df.where(c_(p).isNotNull() & c_(y).isNotNull()).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c_(p) * c_(y)).alias("xy"), F.sum(c_(p) * c_(p)).alias("xx"), F.sum(c_(y) * c_(y)).alias("yy"))


def symbol_guard(df: DataFrame, val: Column, p: str, y: str = "label", ic_below: float = -0.01, weight: float = 0.0, min_count: int = 100,
                 out: str = "pred") -> DataFrame:
    """Shrink symbols whose validation IC is at or below a threshold by a fixed weight."""
    s = symbol_sums(df.where(val), p, y)
    bad = s.where((c_("n") >= min_count) & (c_("xy") / F.sqrt(c_("xx") * c_("yy")) <= ic_below)).select("symbol", F.lit(float(weight)).alias("_w"))
    return df.join(bad, "symbol", "left").withColumn(out, c_(p) * F.coalesce("_w", F.lit(1.0))).drop("_w")


def guard_weights(sums: Sequence, grid: Sequence[float], ic_below: float, min_count: int) -> list[tuple[str, float, float]]:
    """Sequential choice by rising IC: each symbol's weight sees those already set (a table of symbols)."""
    xy, xx, yy = (float(sum(r[k] for r in sums)) for k in ("xy", "xx", "yy"))
    rows = sorted(((r["xy"] / np.sqrt(max(r["xx"] * r["yy"], 1e-30)), r["symbol"], r) for r in sums if r["n"] >= min_count), key=lambda t: t[:2])
    out = []
    for ic, symbol, r in rows:
        if ic > ic_below:
            continue
        score = lambda w: (xy + (w - 1) * r["xy"]) / np.sqrt(max((xx + (w * w - 1) * r["xx"]) * yy, 1e-30))
        w = max(grid, key=lambda v: (score(v), -v))
        xy, xx = xy + (w - 1) * r["xy"], xx + (w * w - 1) * r["xx"]
        out.append((symbol, float(w), float(ic)))
    return out


def symbol_guard_grid(df: DataFrame, val: Column, p: str, grid: Sequence[float], y: str = "label", ic_below: float = -0.01, min_count: int = 100,
                      out: str = "pred") -> DataFrame:
    """The same with a weight per symbol from a grid; sums per symbol decide, rows are scaled in Spark."""
    chosen = guard_weights(list(symbol_sums(df.where(val), p, y).toLocalIterator()), grid, ic_below, min_count)
    if not chosen:
        return df.withColumn(out, c_(p))
    table = df.sparkSession.createDataFrame([(s, w) for s, w, _ in chosen], "symbol string, _w double")
    return df.join(table, "symbol", "left").withColumn(out, c_(p) * F.coalesce("_w", F.lit(1.0))).drop("_w")


def guard_moments(df: DataFrame, val: Column, current: str, candidates: Sequence[str], y: str = "label") -> DataFrame:
    """One row a symbol that has rows on both sides of ``val``: the sums from which any blend of a candidate into it is scored."""
    cols = [current, *candidates]
    use = df.where(c_(y).isNotNull() & c_(current).isNotNull())
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(c_(y) * c_(y)).alias("yy")]
    for j, v in enumerate(F.coalesce(c_(x), F.lit(0.0)) for x in cols):  # a missing candidate is 0
        sums += [F.sum(v).alias(f"s{j}"), F.sum(v * c_(y)).alias(f"y{j}"), F.sum(v * v).alias(f"g{j}"), F.sum(c_(current) * v).alias(f"c{j}")]
    return use.where(val).groupBy("symbol").agg(*sums).join(df.where(~val).select("symbol").distinct(), "symbol")


def candidate_guard(df: DataFrame, val: Column, current: str, candidates: Sequence[str], weights: Sequence[float], y: str = "label", min_count: int = 100,
                    ic_lte: float | None = -0.01, ic_gte: float | None = None, max_symbols: int = 0, rescale: bool = False, min_full: float = 0.0,
                    min_group: float = 0.0, max_drop: float = 0.0) -> DataFrame:
    """symbol, candidate, weight, scale, shift, symbol_ic, symbol_ic_after, ic_before, ic_after: where a candidate replaces part of a prediction.

    Symbols with enough validation rows whose own IC is at most ``ic_lte`` or at least ``ic_gte`` are eligible, and are gone through by rising IC (by
    falling IC if only ``ic_gte`` is given). Each takes the candidate and weight that raise the whole IC most, if the symbol's IC gains
    ``min_group`` and the whole IC gains ``min_full`` and falls by no more than ``max_drop``; the next symbol sees what was taken. With ``rescale``, a candidate is first brought to the mean and deviation of
    the prediction on the symbol. The walk is one task over a sorted table of symbols; it holds three sums and a batch.
    """
    names = sorted(candidates)
    mo = guard_moments(df, val, current, names, y)
    ic = F.when((c_("n") >= 2) & (c_("g0") * c_("yy") > 0), c_("y0") / F.sqrt(c_("g0") * c_("yy")))
    low = F.lit(False) if ic_lte is None else c_("ic") <= ic_lte
    high = F.lit(False) if ic_gte is None else c_("ic") >= ic_gte
    whole = df.where(val & c_(y).isNotNull() & c_(current).isNotNull()).agg(
        F.sum(c_(current) * c_(y)).alias("_xy"), F.sum(c_(current) * c_(current)).alias("_xx"), F.sum(c_(y) * c_(y)).alias("_yy"))
    order = c_("ic").desc() if ic_lte is None else c_("ic").asc()
    table = mo.withColumn("ic", ic).where((c_("n") >= min_count) & (low | high)).transform(scalars(whole))
    if max_symbols:
        table = table.orderBy(order, "symbol").limit(max_symbols)
    grid = sorted({0.0, *map(float, weights)})

    def walk(batches):
        xy = xx = yy = None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if xy is None:
                    xy, xx, yy = r["_xy"], r["_xx"], r["_yy"]
                before, own, best = xy / np.sqrt(xx * yy), r["ic"], None
                for j, name in enumerate(names, 1):
                    a, b = _to_scale(r, j) if rescale else (1.0, 0.0)
                    cy, cc, c0 = a * r[f"y{j}"] + b * r["sy"], a * a * r[f"g{j}"] + 2 * a * b * r[f"s{j}"] + b * b * r["n"], a * r[f"c{j}"] + b * r["s0"]
                    for w in grid:
                        new_y = (1 - w) * r["y0"] + w * cy
                        new_x = (1 - w) ** 2 * r["g0"] + 2 * w * (1 - w) * c0 + w * w * cc
                        all_x = xx - r["g0"] + new_x
                        if new_x <= 0 or all_x <= 0:
                            continue
                        group, full = new_y / np.sqrt(new_x * r["yy"]), (xy - r["y0"] + new_y) / np.sqrt(all_x * yy)
                        if group < own + min_group or full < before - max_drop or full < before + min_full:
                            continue
                        if (full, group) > ((before, own) if best is None else best[:2]):
                            best = (full, group, name, w, a, b, new_y, new_x)
                if best and best[3]:
                    xy, xx = xy - r["y0"] + best[6], xx - r["g0"] + best[7]
                    out.append((r["symbol"], best[2], best[3], best[4], best[5], own, best[1], before, best[0]))
            yield pd.DataFrame(out, columns=["symbol", "candidate", "weight", "scale", "shift", "symbol_ic", "symbol_ic_after", "ic_before", "ic_after"])

    return table.repartition(1).sortWithinPartitions(order, "symbol").mapInPandas(
        walk, "symbol string, candidate string, weight double, scale double, shift double, symbol_ic double, symbol_ic_after double, ic_before double, ic_after double")


def _to_scale(r: dict, j: int) -> tuple[float, float]:
    """Factor and shift that bring a candidate to the mean and deviation of the prediction on a symbol."""
    n = r["n"]
    m0, m = r["s0"] / n, r[f"s{j}"] / n
    d0, d = (np.sqrt(max(r[f"g{k}"] / n - v * v, 0.0)) for k, v in ((0, m0), (j, m)))
    a = max(d0, 1e-8) / max(d, 1e-8)
    return a, m0 - a * m


def apply_candidate_guard(df: DataFrame, chosen: DataFrame, current: str, candidates: Sequence[str], out: str = "pred") -> DataFrame:
    """The guarded prediction of every row: symbols without a choice keep theirs."""
    own = F.coalesce(*[F.when(c_("candidate") == n, c_(n)) for n in candidates], F.lit(0.0))
    mixed = (F.lit(1.0) - c_("weight")) * c_(current) + c_("weight") * (c_("scale") * own + c_("shift"))
    d = df.join(chosen.select("symbol", "candidate", "weight", "scale", "shift"), "symbol", "left")
    return d.withColumn(out, F.coalesce(mixed, c_(current))).drop("candidate", "weight", "scale", "shift")


def month_offsets(df: DataFrame, month: str = "month", out: str = "offset") -> DataFrame:
    """Place of each month in the frame (first month 0); months are numbered apart from the rows."""
    m = df.select(month).distinct().withColumn(out, F.row_number().over(Window.orderBy(month)) - 1)
    return df.join(m, month, "inner")


def override_by_offset(df: DataFrame, base: str, other: str, offsets: Sequence[int], period: int, out: str = "pred") -> DataFrame:
    """Another prediction in chosen months of each window of ``period`` months."""
    d = month_offsets(df)
    return d.withColumn(out, F.when((c_("offset") % period).isin(*offsets), c_(other)).otherwise(c_(base)))


def first_rule(metrics: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Name and scale of the first matching rule; an absent bound is open, no match scales by one."""
    name, scale = F.lit(None).cast("string"), F.lit(1.0)
    for r in reversed(list(rules)):
        ok = F.lit(True)
        for field, lo, hi in (("ic", "ic_gte", "ic_lte"), ("memory_weight", "mem_gte", "mem_lte")):
            ok = ok & (c_(field) >= r[lo] if r.get(lo) is not None else F.lit(True))
            ok = ok & (c_(field) <= r[hi] if r.get(hi) is not None else F.lit(True))
        name = F.when(ok, F.lit(r["name"])).otherwise(name)
        scale = F.when(ok, F.lit(float(r.get("scale", 1.0)))).otherwise(scale)
    return metrics.withColumns({"rule": name, "scale": scale})
