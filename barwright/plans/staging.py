"""Where shared intermediate tables are written.

A staged table cuts the lineage: it is a Parquet table in the shared folder the cluster names in
``spark.checkpoint.dir``, so it survives the loss of any executor and keeps column pruning,
pushed filters and file statistics, which an RDD checkpoint would lose.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reuse(spark: SparkSession, name: str, meta: dict, build: Callable[[], DataFrame], folder: str | None = None) -> tuple[DataFrame, bool]:
    """A table built once per description: same ``meta``, same table; anything else is built anew.

    Keep what is costly (features) and what varies (targets) under separate descriptions, so that a
    change of target mode reuses the features. Returns the table and whether it was there already.
    """
    tag = hashlib.sha256(json.dumps(meta, sort_keys=True, default=str).encode()).hexdigest()[:20]
    path = f"{folder or shared_dir(spark)}/{name}-{tag}"
    try:
        return spark.read.parquet(path), True
    except AnalysisException:  # absent, or a failed write that committed nothing
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), False


def release(spark: SparkSession) -> None:
    """Remove all tables this application staged. Call it when no result that reads them is still to be computed.

    Tables of ``reuse`` are kept: they are meant to outlive the application.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
