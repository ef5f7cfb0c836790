"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import ann, chat, licenses, media, merkle, mixing, near, packing, shared, token_files, toxicity, warc, weighted, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents")).drop("ids")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op3_minhash_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    return near.components_of(_table(spark, folder, "documents")).drop("text_key")


def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_columns(_table(spark, folder, "documents")).drop("digest", "shard", "offset", "length")


def op5_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    return warc.pages_of(warc.round_trip(_table(spark, folder, "pages")))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write(_table(spark, folder, "documents"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one more, whose texts are control strings."""
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").union(extra)
    formatted, _ = shared.keep(chat.chat(turns.withColumn("parts", chat.text_part(F.col("text")))), "chat")
    return chat.digests(formatted)


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).drop("source", "copies")


def op10_rotated_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"))


def op9_noisy_or_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(_table(spark, folder, "documents"))


def op13_weighted_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return weighted.fingerprints(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder).drop("ids")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_power_of_two_packing, op2_license_scan, op3_minhash_hamming_join, op4_media_columns, op5_warc_salvage, op6_token_files, op7_chat_format,
    op8_source_mix, op9_noisy_or_toxicity, op10_rotated_bit_search, op11_embedding_whitening, op12_merkle_manifest,
    op13_weighted_fingerprint, pipeline)}


OP3 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
  n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.reached FROM r JOIN e ON r.doc_id = e.a)
  SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id"""

SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle_sql(), "op3_minhash_hamming_join": OP3, "op7_chat_format": chat.ORACLE, "op8_source_mix": mixing.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE}
