"""Additive statistics. Rows are read once; every fit, grid and score then works on sums.

``gram`` yields one row per group with ``n``, per-column sums, ``X'y``, ``X'X`` and ``y'y``.
Groups (months, days, buckets) add up, so any training window is a sum of a few small rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

INLINE_COLUMNS = 24


def pair_names(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: Column | None = None) -> DataFrame:
    """One row per group: n, w, sx, c, g (upper triangle), sy, yy; rows with a NULL are left out."""
    need = [F.col(c).isNotNull() for c in (*xs, y)]
    cond = need[0]
    for c in need[1:]:
        cond = cond & c
    if len(xs) > INLINE_COLUMNS:
        return _gram_blocks(df.where(cond), list(keys), list(xs), y, weight)
    w = weight if weight is not None else F.lit(1.0)
    rows = df.where(cond).withColumn("_w", w.cast("double"))
    x = [F.col(c).cast("double") for c in xs]
    t = F.col(y).cast("double")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_w").alias("w"),
        F.array(*[F.sum(F.col("_w") * a) for a in x]).alias("sx"),
        F.array(*[F.sum(F.col("_w") * a * t) for a in x]).alias("c"),
        F.array(*[F.sum(F.col("_w") * x[i] * x[j]) for i, j in pair_names(len(xs))]).alias("g"),
        F.sum(F.col("_w") * t).alias("sy"),
        F.sum(F.col("_w") * t * t).alias("yy"))


def _gram_blocks(df: DataFrame, keys: list[str], xs: list[str], y: str, weight: Column | None) -> DataFrame:
    """The same for hundreds of columns: a matrix product per Arrow batch, then sums by position."""
    w = weight if weight is not None else F.lit(1.0)
    src = df.select(*keys, *xs, F.col(y).alias("_y"), w.cast("double").alias("_w"))
    k = len(xs)
    upper = np.triu_indices(k)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.select(*keys).schema.fields)
    schema = (fields + ", " if keys else "") + "_v array<double>"

    def partial(batches):
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                a = part[xs].to_numpy(dtype=np.float64)
                t = part["_y"].to_numpy(dtype=np.float64)
                v = part["_w"].to_numpy(dtype=np.float64)
                aw = a * v[:, None]
                flat = np.concatenate([[len(part), v.sum(), (v * t).sum(), (v * t * t).sum()],
                                       aw.sum(0), aw.T @ t, (aw.T @ a)[upper]])
                yield pd.DataFrame({**{n: [kv] for n, kv in zip(keys, key)}, "_v": [flat]})

    cells = (src.mapInPandas(partial, schema)
             .select(*keys, F.posexplode("_v").alias("_i", "_x"))
             .groupBy(*keys, "_i").agg(F.sum("_x").alias("_x")))
    packed = cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))
    return packed.select(
        *keys, F.col("_v")[0].cast("long").alias("n"), F.col("_v")[1].alias("w"),
        F.slice("_v", 5, k).alias("sx"), F.slice("_v", 5 + k, k).alias("c"),
        F.slice("_v", 5 + 2 * k, k * (k + 1) // 2).alias("g"),
        F.col("_v")[2].alias("sy"), F.col("_v")[3].alias("yy"))


def add_up(stats: DataFrame, keys: Sequence[str], k: int, weight: Column | None = None) -> DataFrame:
    """Sum group statistics (optionally weighted) into coarser groups."""
    w = weight if weight is not None else F.lit(1.0)
    s = stats.withColumn("_f", w.cast("double"))

    def arr(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.col("_f") * F.col(name)[i]) for i in range(size)]).alias(name)

    m = k * (k + 1) // 2
    return s.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("_f") * F.col("w")).alias("w"),
        arr("sx", k), arr("c", k), arr("g", m),
        F.sum(F.col("_f") * F.col("sy")).alias("sy"), F.sum(F.col("_f") * F.col("yy")).alias("yy"))


@dataclass
class Stats:
    """Statistics of one group on the driver: k-vectors and a k x k matrix, never rows."""

    n: float
    w: float
    sx: np.ndarray
    c: np.ndarray
    g: np.ndarray
    sy: float
    yy: float

    @classmethod
    def of(cls, row, k: int | None = None) -> "Stats":
        sx = np.array(row["sx"], dtype=float)
        k = len(sx)
        g = np.zeros((k, k))
        g[np.triu_indices(k)] = row["g"]
        g = g + np.triu(g, 1).T
        return cls(row["n"], row["w"], sx, np.array(row["c"], float), g, row["sy"], row["yy"])

    def __add__(self, o: "Stats") -> "Stats":
        return Stats(self.n + o.n, self.w + o.w, self.sx + o.sx, self.c + o.c, self.g + o.g,
                     self.sy + o.sy, self.yy + o.yy)

    def __sub__(self, o: "Stats") -> "Stats":
        return self + o.scaled(-1.0)

    def scaled(self, f: float) -> "Stats":
        return Stats(self.n * f, self.w * f, self.sx * f, self.c * f, self.g * f, self.sy * f, self.yy * f)

    def take(self, idx: Sequence[int]) -> "Stats":
        i = np.asarray(idx)
        return Stats(self.n, self.w, self.sx[i], self.c[i], self.g[np.ix_(i, i)], self.sy, self.yy)

    @property
    def mean(self) -> np.ndarray:
        return self.sx / self.w

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.g) / self.w - self.mean ** 2, 0.0))

    def standardised(self) -> "Stats":
        """Statistics of (x - mean) / std and y - mean(y)."""
        m, s = self.mean, np.where(self.std > 1e-12, self.std, 1.0)
        g = (self.g - self.w * np.outer(m, m)) / np.outer(s, s)
        c = (self.c - m * self.sy) / s
        return Stats(self.n, self.w, np.zeros_like(m), c, g, 0.0, self.yy - self.sy ** 2 / self.w)

    def ic(self, weights: np.ndarray) -> float:
        """Uncentred information coefficient of the blend X w."""
        q = float(weights @ self.g @ weights)
        return float(weights @ self.c) / np.sqrt(q * self.yy) if q > 1e-18 and self.yy > 1e-18 else 0.0

    def corr(self) -> np.ndarray:
        m = self.mean
        cov = self.g / self.w - np.outer(m, m)
        s = np.sqrt(np.maximum(np.diag(cov), 1e-30))
        return cov / np.outer(s, s)


def total(stats: Sequence[Stats]) -> Stats:
    out = stats[0]
    for s in stats[1:]:
        out = out + s
    return out


def score(xs: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Dot product of columns and solved weights, as a plain column expression."""
    out = F.lit(float(intercept))
    for c, w in zip(xs, weights):
        if w:
            out = out + F.lit(float(w)) * F.col(c)
    return out
