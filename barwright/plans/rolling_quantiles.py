"""Exact quantiles of the times before each time, from counts that add up.

Rows are counted by (time, part, cell), and a window's counts are the sums of its times' counts: the rows themselves are never
copied to the windows they belong to. Cells keep the order of the values. The cells in which the wanted positions fall are cut
finer, until each holds one value; only rows in such cells are read on, so every round works on a small part of the one before.
A group is at most the cells of one round (``SPLIT``, or the exponent range in the first one), whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.plans.staging import stage

OCTAVE = 64     # cells a doubling of the value, first round
SPLIT = 4096    # cells that a cell is cut into, later rounds

c_ = F.col


def _coarse(x: Column) -> Column:
    """A cell number that never falls as x rises; 1,100 lies above the largest binary logarithm of any double in size."""
    level = F.floor((F.log2(F.abs(x)) + F.lit(1100.0)) * F.lit(float(OCTAVE))) + 1
    return F.when(x > 0, level).when(x < 0, -level).otherwise(F.lit(0)).cast("long")


def _fine(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(SPLIT))), F.lit(SPLIT - 1)).cast("long")


def rolling_quantiles(values: DataFrame, lookback: int, probs: Mapping[str, Sequence[float]]) -> DataFrame:
    """(time, part, n, edges) for every time that has a past; edges follow the order of ``probs[part]``, linearly interpolated.

    ``values`` has an integer ``time``, ``part`` and ``x``. Null and non-finite x count nowhere. A window holds the times from
    ``time - lookback`` to ``time - 1``.
    """
    x = c_("x").cast("double")
    rows = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).select(
        "time", "part", x.alias("x"), F.lit("").alias("parent"), _coarse(x).alias("cell"))
    asked = values.select(c_("time").alias("at")).distinct()
    wanted, done = None, None
    while True:
        cells = stage(rows.groupBy("time", "part", "parent", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "quantile-cells")
        window = cells.withColumn("at", F.explode(F.sequence(c_("time") + 1, c_("time") + lookback))).join(asked, "at", "left_semi")
        counts = window.groupBy("at", "part", "parent", "cell").agg(F.sum("n").alias("n"))
        if wanted is None:
            wanted = _positions(counts, probs)
        so_far = Window.partitionBy("at", "part", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(so_far))
        # bounds over all times, so that a cell is cut at the same places for every window
        bounds = cells.groupBy("part", "parent", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        inside = (c_("pos") < c_("below") + c_("upto")) & (c_("pos") >= c_("below") + c_("upto") - c_("n"))
        hits = (wanted.join(counts, ["at", "part", "parent"]).where(inside).join(bounds, ["part", "parent", "cell"])
                .select("at", "part", "i", "high", "pos", "share", "total", (c_("below") + c_("upto") - c_("n")).alias("below"),
                        "parent", "cell", "lo", "hi"))
        hits = stage(hits, "quantile-hits")
        found = hits.where("lo = hi").select("at", "part", "i", "high", "share", "total", c_("lo").alias("v"))
        done = found if done is None else done.unionByName(found)
        left = hits.where("lo < hi")
        if left.isEmpty():
            break
        path = F.concat_ws(".", F.when(c_("parent") != "", c_("parent")), c_("cell").cast("string"))
        cut = left.select("part", "parent", "cell", "lo", "hi").distinct()
        rows = stage(rows.join(cut, ["part", "parent", "cell"]).select(
            "time", "part", "x", path.alias("parent"), _fine(c_("x"), c_("lo"), c_("hi")).alias("cell")), "quantile-rows")
        wanted = left.select("at", "part", "i", "high", "pos", "share", "total", "below", path.alias("parent"))
    ends = done.groupBy("at", "part", "total", "i", "share").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    value = c_("a") + (c_("b") - c_("a")) * c_("share")
    return (ends.groupBy("at", "part", "total").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("_e"))
            .select(c_("at").alias("time"), "part", c_("total").alias("n"), F.transform("_e", lambda s: s["v"]).alias("edges")))


def _positions(counts: DataFrame, probs: Mapping[str, Sequence[float]]) -> DataFrame:
    """Two order statistics for each quantile: at the floor and at the ceiling of its place."""
    asked = F.create_map(*[e for part, ps in probs.items() for e in (
        F.lit(part), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(ps)]))])
    place = c_("q.p") * (c_("total") - 1)
    d = counts.groupBy("at", "part").agg(F.sum("n").alias("total")).withColumn("q", F.explode(F.element_at(asked, c_("part"))))
    d = d.withColumn("high", F.explode(F.array(F.lit(False), F.lit(True))))
    return d.select("at", "part", "total", c_("q.i").alias("i"), "high", (place - F.floor(place)).alias("share"),
                    F.when(c_("high"), F.ceil(place)).otherwise(F.floor(place)).alias("pos"), F.lit("").alias("parent"),
                    F.lit(0).cast("long").alias("below"))
