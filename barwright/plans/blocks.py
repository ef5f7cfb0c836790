"""Thousands of columns in blocks: each block is a staged table of keys and one array, and figures over pairs of columns come block by block.

A frame of all columns would cost the planner far more than the data costs the cluster. Sums over columns and products over pairs of columns are added
inside tasks; what leaves a task has the size of the columns, not of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.plans.staging import stage

c_ = F.col
CHUNK = 2048   # rows whose columns are held together for a product
TILE = 256     # columns on a side of a block of products


class Block(NamedTuple):
    """A staged table of ``meta`` columns and ``v``, the values of ``names``."""
    df: DataFrame
    names: tuple[str, ...]

    def columns(self, names: Sequence[str], meta: Sequence[str]) -> DataFrame:
        return self.df.select(*meta, *[c_("v")[self.names.index(n)].alias(n) for n in names])


class Score(NamedTuple):
    name: str
    ic: float
    coverage: float
    n: int
    mean: float
    sd: float


def block_of(frame: DataFrame, names: Sequence[str], meta: Sequence[str], label: str = "block") -> Block:
    return Block(stage(frame.select(*meta, F.array(*[c_(n).cast("double") for n in names]).alias("v")), label), tuple(names))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Values of a column of arrays; what is missing or not finite is 0."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.where(np.isfinite(x), x, 0.0)


def column_scores(block: Block, y: str) -> list[Score]:
    """IC, coverage (share of values other than 0), rows, mean and deviation of each column over rows with a label, in one pass."""
    k = len(block.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, k))
        for batch in batches:
            t, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), k)
            sums += np.stack([np.full(k, len(t)), np.full(k, t @ t), x.sum(axis=0), (x * x).sum(axis=0), t @ x, (x != 0).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k))] + [pa.array(s) for s in sums], ["at", "n", "yy", "x", "xx", "xy", "nz"])

    rows = block.df.where(c_(y).isNotNull()).select(c_(y).cast("double"), "v").mapInArrow(
        each, "at long, n double, yy double, x double, xx double, xy double, nz double")
    total = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "yy", "x", "xx", "xy", "nz")])
    out = []
    for r in sorted(total.collect()):  # one row a column
        n = max(r.n, 1.0)
        out.append(Score(block.names[r.at], r.xy / np.sqrt(max(r.xx * r.yy, 1e-24)), r.nz / n, int(r.n), r.x / n,
                         float(np.sqrt(max(r.xx / n - (r.x / n) ** 2, 0.0)))))
    return out


def correlated(blocks: Sequence[Block], chosen: Sequence[Sequence[Score]], keys: Sequence[str], y: str, limit: float, rows: int) -> DataFrame:
    """(a, b, corr): pairs of the chosen columns with |corr| of at least ``limit`` over rows with a label; a < b count the chosen columns.

    All blocks must have the same rows. They are dealt by a hash of their keys to chunks, so one shuffle brings the columns of a row together; a task
    adds the products of its chunks, and each pair of column tiles is then summed by itself.
    """
    use = [(b, s) for b, s in zip(blocks, chosen) if s]
    width = [len(s) for _, s in use]
    start = np.concatenate([[0], np.cumsum(width)]).astype(int)
    mean = np.array([s.mean for _, t in use for s in t])
    sd = np.array([s.sd for _, t in use for s in t])
    scale = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1e-300), sd, np.inf)
    chunk = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // CHUNK)))).alias("chunk")
    parts = [b.df.where(c_(y).isNotNull()).select(chunk, F.lit(i).alias("block"), *keys, F.array(*[c_("v")[b.names.index(s.name)] for s in t]).alias("v"))
             for i, (b, t) in enumerate(use)]
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, at = np.zeros((len(mean), len(mean))), [[] for _ in width], None

        def add() -> None:
            z = (np.hstack([np.concatenate(h) for h in held]) - mean) / scale
            total.__iadd__(z.T @ z)
            for h in held:
                h.clear()

        for batch in batches:
            where = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(where[0]) != 0) | (np.diff(where[1]) != 0)) + 1
            for low, high in zip(np.r_[0, edge], np.r_[edge, batch.num_rows]):
                if low == high:
                    continue
                if at is not None and at != where[0][low]:
                    add()
                at, b = where[0][low], where[1][low]
                held[b].append(_matrix(batch.column(2).slice(low, high - low), width[b]))
        if at is not None:
            add()
            for i in range(0, len(mean), TILE):
                for j in range(i, len(mean), TILE):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([np.ascontiguousarray(total[i:i + TILE, j:j + TILE]).tobytes()])],
                                                     ["i", "j", "tile"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None

        def edges() -> pa.RecordBatch:
            i, j = key
            corr = tile.reshape(min(TILE, len(mean) - i), -1) / n
            a, b = np.nonzero((np.abs(corr) >= limit) & (np.arange(i, i + corr.shape[0])[:, None] < np.arange(j, j + corr.shape[1])))
            return pa.RecordBatch.from_arrays([pa.array(a + i), pa.array(b + j), pa.array(corr[a, b])], ["a", "b", "corr"])

        for batch in batches:
            for i, j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (i, j):
                    yield edges()
                    key = None
                tile = np.frombuffer(raw, "<f8") + (tile if key is not None else 0.0)
                key = (i, j)
        if key is not None:
            yield edges()

    n = use[0][1][0].n
    dealt = frame.repartition("chunk").sortWithinPartitions("chunk", "block", *keys).select("chunk", "block", "v")
    tiles = dealt.mapInArrow(products, "i long, j long, tile binary")
    return tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(merge, "a long, b long, corr double")


def together(blocks: Sequence[Block], chosen: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """One row a key with the chosen columns of all blocks, by one shuffle however many blocks there are."""
    use = [(b, list(n)) for b, n in zip(blocks, chosen) if n]
    frame = None
    for i, (b, names) in enumerate(use):
        part = b.df.select(*keys, F.lit(i).alias("block"), F.array(*[c_("v")[b.names.index(n)] for n in names]).alias("v"))
        frame = part if frame is None else frame.unionByName(part)
    rows = frame.groupBy(*keys).agg(*[F.first(F.when(c_("block") == i, c_("v")), ignorenulls=True).alias(f"_{i}") for i in range(len(use))])
    return rows.select(*keys, *[c_(f"_{i}")[k].alias(n) for i, (_, names) in enumerate(use) for k, n in enumerate(names)])
