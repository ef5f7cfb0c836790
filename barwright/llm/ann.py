"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, less a centre, is scaled to length one, padded to ``bits`` dimensions and rotated at random; its code is the signs. With x the
sign vector over sqrt(bits) and o the rotated vector, <o, q> is estimated by <x, q> / <x, o>; the scalar <x, o> is kept with the code. The
error is below EPSILON * sqrt((1 - <x, o>^2) / <x, o>^2 / (bits - 1)) but for rare cases. The vectors with the smallest estimates are reranked on their
original values in double precision; then those whose least possible distance is not above the tenth-smallest found so far. Bounds that are not finite,
as of vectors whose squares overflow, exclude nothing.

Vectors are dealt into blocks by a hash of their id and queries into blocks of ``QUERIES``; each pair of blocks is one task group that puts out
its k nearest for every query, so no list of a query grows with the data's size beyond k a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barwright.llm.shared import keep

K, EVERY, EPSILON = 10, 100, 3.0
FIRST = 4  # times k: vectors reranked for a first limit
BLOCK, QUERIES = 8192, 4096
CENTRE_SAMPLE, SEED = 4096, 20240607


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vector (little-endian doubles): rows with an id and a vector that is neither null nor zero and has only finite components.

    Of rows that share an id one counts, the smallest by bytes. Extra columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v.values, "<f8").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "vector"])

    return rows.mapInArrow(pack, "vec_id long, vector binary").groupBy("vec_id").agg(F.min("vector").alias("vector")).select(
        "vec_id", (F.octet_length("vector") / 8).cast("int").alias("dim"), "vector")


def code_bits(dim: int) -> int:
    return 64 * -(-4 * dim // 64)


def rotation(dim: int) -> np.ndarray:
    """bits x dim: the first columns of a random orthogonal matrix."""
    bits = code_bits(dim)
    q, _ = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((bits, dim)))
    return q.astype(np.float32)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; where squares leave the range of doubles, of the row over its largest entry."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        plain = np.sqrt((x * x).sum(axis=1))
        far = ~((plain > 1e-140) & (plain < 1e150))
        if far.any():
            most = np.abs(x[far]).max(axis=1)
            scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
            plain[far] = np.sqrt(((x[far] / scale[:, None]) ** 2).sum(axis=1)) * scale
    return plain


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and corrections <x, o> of centred vectors."""
    length = lengths(x)
    with np.errstate(invalid="ignore"):
        o = np.nan_to_num(x / np.where(length > 0, length, 1)[:, None]).astype(np.float32) @ turn.T
    signs = o > 0
    fit = np.abs(o).sum(axis=1, dtype=np.float64) / np.sqrt(turn.shape[0])
    return np.packbits(signs, axis=1), length, np.where(length > 0, fit, 1.0)


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Median of each entry over the at most CENTRE_SAMPLE vectors with the smallest hash, per dimension. Any centre keeps the bounds true; a few
    vectors far away do not move this one."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_SAMPLE).select("dim", "vector").toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for dim, raw in zip(sample.column("dim").to_pylist(), sample.column("vector").to_pylist()):
        out.setdefault(dim, []).append(np.frombuffer(raw, "<f8"))
    return {dim: np.median(v, axis=0) for dim, v in out.items()}


def build_index(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index of ``valid`` rows, in a table in the shared folder: vec_id, dim, vector, code, length, fit; and the centres."""
    rows, _ = keep(rows, "vectors")
    middle = centres(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                if dim not in turns:
                    turns[dim] = rotation(dim)
                part = batch.filter(pa.array(dims == dim))
                for low in range(0, part.num_rows, 2048):
                    some = part.slice(low, 2048)
                    x = np.frombuffer(b"".join(some.column(2).to_pylist()), "<f8").reshape(-1, dim)
                    code, length, fit = encode(x - middle.get(dim, 0.0), turns[dim])
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(fit)],
                                                     ["vec_id", "dim", "vector", "code", "length", "fit"])

    return keep(rows.mapInArrow(each, "vec_id long, dim int, vector binary, code binary, length double, fit double"), "codes")[0], middle


def search_block(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray,
                 centre: np.ndarray | float, turn: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, neighbour, distance): the k nearest of a block for each query, chosen by bounds and reranked."""
    bits = turn.shape[0]
    signs = (np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    slack = EPSILON * np.sqrt(np.maximum(1 - fit * fit, 0) / (fit * fit) / (bits - 1))
    for low in range(0, len(own), 256):
        r = queries[low:low + 256] - centre
        size = lengths(r)
        with np.errstate(invalid="ignore"):
            dots = np.nan_to_num(r / np.where(size > 0, size, 1)[:, None]).astype(np.float32) @ turn.T @ signs.T
        for j in range(len(r)):
            at = np.flatnonzero(ids != own[low + j])
            with np.errstate(over="ignore", invalid="ignore"):
                scale = 2 * size[j] * length[at]
                middle = length[at] ** 2 + size[j] ** 2 - scale * dots[j, at] / fit[at]
                least = middle - scale * slack[at]
            if len(at) > FIRST * k:
                # not comparable bounds come first
                rank = np.where(np.isfinite(least), middle, -np.inf)
                first = np.argpartition(rank, FIRST * k)[:FIRST * k]
                limit = np.partition(lengths(x[at[first]] - queries[low + j]), k - 1)[k - 1]
                with np.errstate(over="ignore"):
                    at = at[~(least > limit * limit * (1 + 1e-6))] if limit > 1e-140 else at
            d = lengths(x[at] - queries[low + j])
            for i in np.lexsort((ids[at], d))[:k]:
                yield int(own[low + j]), int(ids[at[i]]), float(d[i])


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest other rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score (Euclidean distance).

    Only vectors of one dimension are compared. A query without candidates has no rows; an empty table gives none. Ties go to the smaller vec_id.
    """
    index, middle = build_index(valid(vectors))
    blocks = max(1, -(-index.count() // BLOCK))
    chosen = index.filter(F.col("vec_id") % every == 0).select("vec_id", "dim", "vector")
    groups = max(1, -(-chosen.count() // QUERIES))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    base = index.withColumn("block", part(blocks, 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = chosen.withColumn("group", part(groups, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def each(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        dim = key[0]
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        matrix = lambda s: np.frombuffer(b"".join(s), "<f8").reshape(-1, dim)
        code = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        rows = list(search_block(q["vec_id"].to_numpy(), matrix(q["vector"]), b["vec_id"].to_numpy(), matrix(b["vector"]), code,
                                 b["length"].to_numpy(), b["fit"].to_numpy(), middle.get(dim, 0.0), rotation(dim), k))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "group", "block"]
    found = asked.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(each, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
