"""Small helpers of this subpackage: spare column names, scratch tables and their removal."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.plans.staging import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever extra columns it brings."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


ROWS_A_FILE = 50_000


def keep(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back and its path, for ``forget``.

    ``rows``, where the caller knows about how many there are, keeps a small table from being cut into as many files as there are shuffle
    partitions: only the number of files follows from it.
    """
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hash_draw(key: Column) -> Column:
    """A number in (0, 1) from the first 60 bits of the MD5 of a text, the same in any engine."""
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 60))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
