"""Row numbers inside groups that may be far too large for one task.

A plain ``row_number().over(partitionBy(key))`` sorts a whole group in one task. Here the order is
cut into buckets first (calendar slices or slices of a hash): rows are numbered inside
(group, bucket), and the start of each bucket is a running sum over the small table of bucket
counts. One shuffle on (group, bucket), no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import epoch_seconds, hash_uniform


def time_bucket(time_col: str, seconds: int) -> Column:
    """Calendar slice. With a unique (group, time) key it holds at most seconds/resolution rows."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time_col}) div {seconds}")


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
                 out: str, total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group.

    ``bucket`` must never decrease along ``order``. ``total`` names an optional group-size column.
    """
    keys = list(keys)
    by = keys + ["_bk"]
    cut = df.withColumn("_bk", bucket)
    # one row per (group, bucket): the number of buckets is fixed by the calendar or the hash width
    sizes = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    seq = Window.partitionBy(*keys).orderBy("_bk")
    starts = sizes.select(
        *by,
        F.coalesce(F.sum("_n").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    local = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return (local.join(starts, by, "inner")
            .withColumn(out, F.col("_start") + F.col("_rn") - F.lit(1))
            .drop("_bk", "_start", "_rn"))


def with_running_sum(df: DataFrame, order: Sequence[str | Column], bucket: Column, value: str, out: str) -> DataFrame:
    """Running sum of a column over the whole frame, by the same two levels."""
    cut = df.withColumn("_bk", bucket)
    sizes = cut.groupBy("_bk").agg(F.sum(value).alias("_s"))
    seq = Window.partitionBy(F.lit(0)).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # buckets only
    starts = sizes.select("_bk", F.coalesce(F.sum("_s").over(seq), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.withColumn("_cum", F.sum(value).over(inside)).join(starts, "_bk", "inner")
            .withColumn(out, F.col("_start") + F.col("_cum")).drop("_bk", "_start", "_cum"))


def hash_slice(u: str, slices: int = 1 << 16) -> Column:
    return F.floor(F.col(u) * F.lit(slices)).cast("long")


def text_bucket(x: str) -> Column:
    """Slice of a text order by its first three characters; never decreases along the order."""
    at = lambda i: F.ascii(F.substring(x, i, 1)).cast("long")
    return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)


def with_codes(df: DataFrame, x: str, out: str) -> DataFrame:
    """Dense 0-based code of a text column in sorted order."""
    codes = with_ordinal(df.select(x).distinct(), [], [x], text_bucket(x), out)
    return df.join(codes, x, "inner")


def with_time_number(df: DataFrame, time_col: str = "datetime", seconds: int = 31536000,
                     out: str = "time_no", desc: bool = False) -> DataFrame:
    """Distinct timestamps with their 0-based position over the whole panel."""
    times = df.select(time_col).distinct()
    bucket = time_bucket(time_col, seconds)
    order = F.col(time_col)
    if desc:
        bucket, order = -bucket, order.desc()
    return with_ordinal(times, [], [order], bucket, out)


def log_slice(key: str, per_octave: int = 1 << 14) -> Column:
    """Slices for positive keys of any scale, so that extreme weights do not pile up in one slice."""
    return F.floor(F.log2(F.greatest(F.col(key), F.lit(1e-300))) * F.lit(per_octave)).cast("long")


def first_n(df: DataFrame, strata: Sequence[str], score: Column, tie: Sequence[str], n: int | Column,
            weighted: bool = False) -> DataFrame:
    """Exactly the ``n`` rows with the lowest score in each stratum.

    Slices that start beyond ``n`` are dropped before any ordering, so about ``n`` rows are sorted.
    """
    strata, limit = list(strata), (F.lit(n) if isinstance(n, int) else n)
    by = [*strata, "_bk"]
    d = df.withColumn("_u", score)
    d = d.withColumns({"_bk": log_slice("_u") if weighted else hash_slice("_u"), "_limit": limit})
    seq = Window.partitionBy(*strata).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*by, F.coalesce(F.sum("_n").over(seq), F.lit(0)).alias("_start"))
    near = d.join(starts, by, "inner").where(F.col("_start") < F.col("_limit"))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy("_u", *tie))
    return (near.withColumn("_rn", rn).where(F.col("_start") + F.col("_rn") <= F.col("_limit"))
            .drop("_u", "_bk", "_limit", "_start", "_rn"))


__all__ = ["time_bucket", "with_ordinal", "hash_slice", "with_time_number", "text_bucket", "with_codes", "log_slice", "first_n",
           "epoch_seconds", "hash_uniform"]
