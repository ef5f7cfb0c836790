"""Documents to training sequences: toxic documents out, near copies out, sources mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import mixing, near, packing, shared, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those the classifier rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near.drop_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence; ids as little-endian unsigned 32-bit integers."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = shared.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: the classifier is fitted by an iterative method and token ids come from a tokenizer: the tests compare with brute force
ORACLE_SQL = None
