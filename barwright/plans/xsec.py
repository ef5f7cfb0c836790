"""Group statistics, ranks and quantiles with a size-checked strategy.

``Groups`` names the grouping keys and the measured size of the largest group. Groups that fit a
task use a window (one shuffle). Without a measured size, or beyond ``WINDOW_ROWS``, statistics are
partial aggregates joined back (adaptive skew join splits a hot key) and ranks and quantiles come
from counts of distinct values cut into value ranges, so no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.plans.staging import stage

WINDOW_ROWS = 200_000
EXACT_ROWS = 1_000_000


@dataclass(frozen=True)
class Groups:
    keys: tuple[str, ...]
    largest: int | None = None

    @property
    def fits(self) -> bool:
        return self.largest is not None and self.largest <= WINDOW_ROWS

    def within(self, *more: str) -> "Groups":
        """Finer keys: groups can only get smaller."""
        return replace(self, keys=tuple(dict.fromkeys(self.keys + more)))


def measure(df: DataFrame, keys: Sequence[str]) -> Groups:
    """Size of the largest group: one partial aggregate over the key columns alone."""
    top = df.groupBy(*keys).count().agg(F.max("count")).head()[0]
    return Groups(tuple(keys), int(top or 0))


def scalars(one: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Add the columns of a one-row frame to every row, as a scalar subquery: no join, no exchange."""
    names = one.columns
    row = one.select(F.struct(*names).alias("_one")).scalar()
    return lambda df: df.withColumn("_one", row).withColumns({n: F.col(f"_one.{n}") for n in names}).drop("_one")


def with_stats(df: DataFrame, g: Groups, aggs: dict[str, Column]) -> DataFrame:
    """Add group aggregates to every row."""
    if g.fits:
        w = Window.partitionBy(*g.keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    stats = df.groupBy(*g.keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(g.keys), "left")


def value_counts(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Distinct values with their count and the number of rows below them.

    Columns: keys, ``x``, ``_c`` (ties), ``_below`` and ``_n`` (non-null rows of the group).

    Equal values are counted first, so a hot value is one row. The counts are then range-partitioned
    by (keys, value): a large group spans several partitions, each with its own running count. The
    ranges are sampled, so they are written once and every later step reads the same ones.
    """
    keys = list(keys)
    vals = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranged = vals.repartitionByRange(*[F.col(k) for k in keys], F.col(x)).withColumn("_r", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_r").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    counted = stage(ranged.withColumn("_cum", F.sum("_c").over(inside)), "value-counts")
    # one row per (group, range): the number of ranges is the number of shuffle partitions
    sizes = counted.groupBy(*keys, "_r").agg(F.max("_cum").alias("_s"))
    seq = Window.partitionBy(*keys).orderBy("_r")
    starts = sizes.select(
        *keys, "_r",
        F.coalesce(F.sum("_s").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_s").over(Window.partitionBy(*keys)).alias("_n"))
    return (counted.join(starts, keys + ["_r"], "inner")
            .select(*keys, x, "_c", (F.col("_start") + F.col("_cum") - F.col("_c")).alias("_below"), "_n"))


def with_rank(df: DataFrame, g: Groups, x: str, rank: str | None = None, count: str | None = None,
              pct: str | None = None) -> DataFrame:
    """Average-tie rank among the non-null values, their count, and rank / count."""
    keys = list(g.keys)
    if g.fits:
        part, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
        ties = Window.partitionBy(*keys, x)
        r = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        n = F.count(x).over(part)
        out = df.withColumns({"_rank": F.when(F.col(x).isNotNull(), r), "_cnt": n})
    else:
        vc = value_counts(df, keys, x).select(
            *keys, x, (F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)).alias("_rank"),
            F.col("_n").alias("_cnt"))
        out = df.join(vc, keys + [x], "left")
    names = {}
    if rank:
        names[rank] = F.col("_rank")
    if count:
        names[count] = F.coalesce(F.col("_cnt"), F.lit(0))
    if pct:
        names[pct] = F.try_divide(F.col("_rank"), F.col("_cnt"))
    return out.withColumns(names).drop("_rank", "_cnt")


def quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float],
              largest: int | None = None, out: str = "edges") -> DataFrame:
    """Linearly interpolated quantiles per group, as one array column in the order of ``probs``."""
    keys = list(keys)
    if largest is not None and largest <= EXACT_ROWS:
        return df.groupBy(*keys).agg(F.percentile(x, F.array(*[F.lit(float(p)) for p in probs])).alias(out))
    vc = value_counts(df, keys, x)
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    pos = lambda q: q["p"] * (F.col("_n") - 1)
    hits = F.filter(want, lambda q: (F.ceil(pos(q)) >= F.col("_below")) &
                    (F.floor(pos(q)) < F.col("_below") + F.col("_c")))
    near = (vc.withColumn("_q", F.explode(hits))
            .withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1))
            .groupBy(*keys, F.col("_q.i").alias("_i"))
            # at most two rows a quantile: the values at the floor and at the ceiling position
            .agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.first("_pos").alias("_pos")))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    return (near.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_a"))
            .select(*keys, F.transform("_a", lambda s: s["v"]).alias(out)))


def edges(df: DataFrame, x: str | Column, probs: Sequence[float], distinct: bool = False) -> list[float]:
    """Quantiles of a whole frame as numbers: as many as ``probs``, whatever the size of the frame.

    The rows are counted first; beyond ``EXACT_ROWS`` they go through counts of distinct values.
    """
    d = df.select((F.col(x) if isinstance(x, str) else x).alias("_x")).where(F.col("_x").isNotNull())
    row = quantiles(d, [], "_x", probs, d.count()).head()
    out = [float(v) for v in (row[0] or []) if v is not None] if row else []
    return sorted(set(out)) if distinct else out
