"""Join shapes, set shapes, ordered picks and unique counting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barwright.plans import chunks
from barwright.plans.ordinal import time_bucket, with_ordinal

KEY = ("symbol", "datetime")


def join_components(frames: Sequence[DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """Inner join of component frames on the panel key; equal keys keep one partitioning throughout."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), frames)


def checked_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Left join that fails when a right key repeats, so the row count cannot change.

    The check sits in the first join key, which no plan can leave out, whichever columns are used.
    """
    cols = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *[F.first(c).alias(c) for c in cols])
    wrong = F.raise_error(F.lit("duplicate key on the right side")).cast(right.schema[keys[0]].dataType)
    one = one.withColumn(keys[0], F.when(F.col("_k") > 1, wrong).otherwise(F.col(keys[0]))).drop("_k")
    return left.join(one, list(keys), "left")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default: float) -> DataFrame:
    """Parameter lookup with a default; the optimizer broadcasts the table when its size allows."""
    return df.join(table.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def lookup_chain(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], value: str, out: str, default: float) -> DataFrame:
    """First hit along several keyed tables, in order."""
    hits = []
    for i, (t, keys) in enumerate(tables):
        df = df.join(t.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
        hits.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*hits, F.lit(default))).drop(*[f"_v{i}" for i in range(len(tables))])


def prior_sums(stats: DataFrame, splits: DataFrame, sums: Sequence[str], time: str = "month") -> DataFrame:
    """Sums of the months inside [tr_start, eval_start) of every split.

    The range join runs on one row per month, never on panel rows.
    """
    cond = (stats[time] >= splits["tr_start"]) & (stats[time] < splits["eval_start"])
    return splits.join(stats, cond, "left").groupBy("split").agg(*[F.sum(s).alias(s) for s in sums])


def attach_state(preds: DataFrame, panel: DataFrame, rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """Bar range, log volume and one-bar return joined to predictions."""
    d = chunks.open_chunks(panel.select("symbol", "datetime", "bar_no", "high", "low", "close", "volume"), 1, 0, rows)
    prev = F.lag("close").over(chunks.bars())
    d = chunks.close_chunks(d.withColumns({
        "state_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "state_logvol": F.log1p(F.greatest(F.col("volume"), F.lit(0.0))),
        "state_ret1": F.try_divide(F.col("close"), prev) - 1}))
    return preds.join(d.select("symbol", "datetime", "state_range", "state_logvol", "state_ret1"), list(KEY), "left")


def union_libraries(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY, prefix: str = "mined_") -> DataFrame:
    """Two factor libraries side by side; a clashing name of the second gets a prefix."""
    clash = {c: prefix + c for c in b.columns if c in a.columns and c not in keys}
    return a.join(b.withColumnsRenamed(clash), list(keys), "inner")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys on one side only (an empty result means aligned frames)."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def drop_tail(df: DataFrame, n: int) -> DataFrame:
    """All but the last n bars of each symbol, from bar numbers (no ordering needed)."""
    return df.where(F.col("symbol_bars") - 1 - F.col("bar_no") >= n)


def every_kth_time(df: DataFrame, k: int, bucket_seconds: int = 31536000) -> DataFrame:
    """Rows at every k-th distinct timestamp: numbered timestamps, then a semi join."""
    times = with_ordinal(df.select("datetime").distinct(), [], ["datetime"], time_bucket("datetime", bucket_seconds), "_i")
    return df.join(times.where(F.col("_i") % k == 0).select("datetime"), "datetime", "left_semi")


def set_of_names(a: DataFrame, b: DataFrame, how: str, name: str = "factor") -> DataFrame:
    """Intersection, or union keeping the first list's order and then the second's."""
    if how == "intersect":
        return a.join(b.select(name), name, "left_semi")
    both = a.select(name, F.lit(0).alias("_l"), "pos").unionByName(b.select(name, F.lit(1).alias("_l"), "pos"))
    return both.groupBy(name).agg(F.min(F.struct("_l", "pos")).alias("_k")).select(name, F.col("_k._l").alias("list"), F.col("_k.pos").alias("pos"))


def visitor_hash(salt: str, address: str | Column) -> Column:
    """First 16 hex digits of the salted SHA-256 of an address."""
    a = F.col(address) if isinstance(address, str) else address
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), a.cast("string")), 256), 1, 16)


def unique_visitors(visits: DataFrame, salt: str, address: str, time: str) -> DataFrame:
    """Visits and unique visitors per day and the running number of visitors ever seen.

    A visitor counts on the day of the first visit; days are numbered by a calendar-bounded table.
    """
    from pyspark.sql import Window
    v = visits.select(F.date_format(time, "yyyy-MM-dd").alias("day"), visitor_hash(salt, address).alias("h"))
    per = v.groupBy("day", "h").agg(F.count(F.lit(1)).alias("k"))
    first = per.groupBy("h").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("new_visitors"))
    days = per.groupBy("day").agg(F.sum("k").alias("visits"), F.count(F.lit(1)).alias("unique_visitors"))
    run = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (days.join(first, "day", "left").withColumn("new_visitors", F.coalesce("new_visitors", F.lit(0)))
            .withColumn("total", F.sum("new_visitors").over(run)))
