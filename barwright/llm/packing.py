"""Packing by power-of-two decomposition.

A document of n ids (its closing id 0 included) is cut into pieces whose lengths are powers of two: as many of the largest
length as fit, then the binary digits of the rest, longest first. Every piece is a sequence of its own, so no sequence
crosses documents and none is padded. Sequences of one length form a bucket, from which batches are drawn.

The work is one pass over the scan without a shuffle: memory is bounded by one document and one output batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import tokens

MAX_LENGTH = 1024
BATCH_BYTES = 8 << 20
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


def lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that sum to n, longest first, none above ``longest``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, bucket
    (binary logarithm of the length), sequence_id, offset (always 0).

    Null and empty texts are one piece, the id 0. Repeated rows and null doc_id are packed like any row; extra columns are
    left out; an empty table gives an empty result. ``sequence_id`` is unique in one build and the same when a task is retried.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    path = path or tokens.vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        rows, held = [], 0
        pour = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.document_ids(encode, text.as_py())
                start = 0
                for n in lengths(len(ids), longest):
                    piece = ids[start:start + n]
                    rows.append((doc_id, start, n, piece.tobytes(), tokens.crc(piece), len(ids)))
                    start += n
                    held += 4 * n + 64
                    if held >= BATCH_BYTES:
                        yield pour()
                        rows, held = [], 0
        if rows:
            yield pour()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)
    return pieces.select("*", F.round(F.log2("length")).cast("int").alias("bucket"),
                         F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Sequences in one folder per bucket, to be read with ``bucket = k``."""
    pieces.write.partitionBy("bucket").parquet(folder)
