"""Whitening of embeddings by principal components, whose basis comes from spectral divide and conquer (``polar``).

Entries become integers, so counts, sums and products add up exactly in any order. The fit list holds each distinct vector once; its sums and
its centred products are added inside tasks, merged over slots in two steps, and only a matrix of the vectors' dimension reaches the driver.
The projection on at most ``COMPONENTS`` components goes out with the tasks: its size is COMPONENTS times the dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barwright.llm import polar
from barwright.llm.shared import keep

COMPONENTS, SCALE, SHIFT = 16, 64.0, 1_000_000
LARGEST = float(1 << 61)  # entries beyond are held at this value, so that differences fit a long
SLOTS, LINES = 64, 64     # first merge: tasks dealt to slots; matrices travel in blocks of lines


class Fit(NamedTuple):
    """Of all vectors with one dimension: their number, exact sums, components as columns over sqrt(eigenvalue), and figures of the fit."""
    n: int
    sums: list[int]
    basis: np.ndarray
    usable: np.ndarray
    explained: np.ndarray
    error: float | None


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x (little-endian 64-bit integers): rows whose vector is neither null nor empty and has only finite entries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(v.flatten().to_numpy(zero_copy_only=False) * SCALE, -LARGEST, LARGEST)).astype("<i8") + SHIFT
            ends = np.cumsum(size)
            raw = [x[e - k:e].tobytes() for e, k in zip(ends, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "x"])

    return rows.mapInArrow(each, "vec_id long, dim int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, x: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one dimension at a time, at most 4096, with their vectors as a matrix of integers."""
    for batch in batches:
        dims = batch.column(dim).to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            for low in range(0, part.num_rows, 4096):
                some = part.slice(low, 4096)
                yield d, some, np.frombuffer(b"".join(some.column(x).to_pylist()), "<i8").reshape(-1, d)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dim -> number of vectors and the exact sum of each entry. High and low halves are added apart, which cannot overflow."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for d, _, x in _blocks(batches, 0, 1):
            n, high, low = total.get(d, (0, 0, 0))
            total[d] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)),
                                              pa.array(high), pa.array(low)], ["dim", "at", "n", "high", "low"])

    rows = (fit.mapInArrow(each, "dim int, at int, n long, high long, low long").groupBy("dim", "at")
            .agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("dim", "at"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.collect():  # one row an entry of a vector
        out.setdefault(r.dim, (int(r.n), []))[1].append((int(r.high) << 32) + int(r.low))
    return out


def products(fit: DataFrame, view: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """dim -> matrix of sums of products of the columns of ``view(dim, x)`` and of a column of ones, which stands last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, _, x in _blocks(batches, 0, 1):
            y = np.column_stack([view(d, x), np.ones(len(x))])
            total[d] = total.get(d, 0.0) + y.T @ y
        slot = TaskContext.get().partitionId() % SLOTS
        for d, g in total.items():
            yield from (_line(d, slot, at, g[at:at + LINES]) for at in range(0, len(g), LINES))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            for d, slot, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key[::2] != (d, at):
                    yield _line(*key, block)
                    key = None
                block = np.frombuffer(raw, "<f8") + (block if key is not None else 0.0)
                key = key or (d, slot, at)
        if key is not None:
            yield _line(*key, block)

    kind = "dim int, slot int, at int, block binary"
    lines = fit.mapInArrow(each, kind)
    for by in (("dim", "at", "slot"), ("dim", "at")):
        lines = lines.repartition(*by).sortWithinPartitions("dim", "at", "slot").mapInArrow(merge, kind)
    blocks: dict[int, list[tuple[int, bytes]]] = {}
    for r in lines.collect():  # in all one matrix a dimension
        blocks.setdefault(r.dim, []).append((r.at, bytes(r.block)))
    out = {}
    for d, parts in blocks.items():
        flat = np.frombuffer(b"".join(raw for _, raw in sorted(parts)), "<f8")
        out[d] = flat.reshape(round(len(flat) ** 0.5), -1)
    return out


def _line(dim: int, slot: int, at: int, block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([slot], pa.int32()), pa.array([at], pa.int32()),
                                       pa.array([np.ascontiguousarray(block, "<f8").tobytes()], pa.binary())], ["dim", "slot", "at", "block"])


def _covariance(g: np.ndarray) -> np.ndarray:
    n, s = g[-1, -1], g[:-1, -1]
    return g[:-1, :-1] / n - np.outer(s / n, s / n)


def _centre(n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest integers to the means, and what is left of the sums: s - n * integer."""
    whole = [(2 * v + n) // (2 * n) for v in s]
    return np.array(whole, np.int64), np.array([v - n * w for v, w in zip(s, whole)], object)


def fit_of(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """dim -> fit on the distinct vectors of ``integers`` rows.

    Products are taken of differences to the integers next to the means, hence exact while they stay below 2^53 in sum, and corrected for what the
    integers leave. A component whose eigenvalue is within rounding of zero is not usable: it has no whitened value.
    """
    fit, _ = keep(rows.select("dim", "x").distinct(), "fit")
    total = sums(fit)
    centre = {d: _centre(*t) for d, t in total.items()}
    whole = {d: c for d, (c, _) in centre.items()}
    cov = {d: _covariance(g) for d, g in products(fit, lambda d, x: (x - whole[d]).astype(np.float64)).items()}
    turned = {}
    for d, v in cov.items():
        e, q = polar.leading(v, min(components, d))
        usable = e > d * polar.EPS * max(e[0], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            explained = e / np.trace(v)
        turned[d] = np.where(usable, q / np.sqrt(np.where(usable, e, 1.0)), 0.0), usable, explained
    rest = {d: (r / total[d][0]).astype(np.float64) for d, (_, r) in centre.items()}
    basis = {d: t[0] for d, t in turned.items()}
    check = products(fit, lambda d, x: ((x - whole[d]) - rest[d]) @ basis[d])
    out = {}
    for d, (b, usable, explained) in turned.items():
        c = _covariance(check[d])[np.ix_(usable, usable)]
        out[d] = Fit(*total[d], b, usable, explained, float(np.abs(c - np.eye(len(c))).max()) if len(c) else None)
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> pa.Array:
    """Sum over the entries of (n * x - s)^2 for each row, exact; null beyond 38 digits."""
    whole, left = _centre(n, s)
    far = float(np.abs(x - whole).max(initial=0)) * n + n
    if far * far * x.shape[1] < 2.0 ** 62:
        away = (x - whole) * n - left.astype(np.int64)
        return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = (((x - whole).astype(object) * n - left) ** 2).sum(axis=1)
    return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out; so are empty vectors, which have no component. Vectors of each
    dimension are fitted for themselves. Repeated rows count once in the fit and come back each; a null vec_id stays null. Where fewer
    components than asked have a spread (few distinct vectors, constant entries), the others have a null ``whitened`` and explain nothing; a fit
    without any spread has null ``explained`` and ``identity_error``. Entries beyond 2^61 / 64 are held there; ``deviation`` is null beyond 38 digits.
    Extra columns are left out; an empty table gives no rows.
    """
    rows = integers(vectors)
    fits = fit_of(rows, components)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part, x in _blocks(batches, 1, 2):
            f = fits[d]
            m, k = len(x), f.basis.shape[1]
            whole, left = _centre(f.n, f.sums)
            z = ((x - whole) - (left / f.n).astype(np.float64)) @ f.basis
            row = np.repeat(np.arange(m), k)
            dull = np.isnan(f.explained)
            fill = lambda v: np.tile(v, m)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(fill(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(m * k, f.n)),
                 deviations(x, f.n, f.sums).take(pa.array(row)), pa.array(z.ravel(), mask=fill(~f.usable)), pa.array(fill(f.explained), mask=fill(dull)),
                 pa.array([f.error] * (m * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(each, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
