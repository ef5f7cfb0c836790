"""Factor screening and selection: sums over the panel in Spark, k x k decisions on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import hash_normal, scrub
from barwright.operators.views import csz
from barwright.plans.moments import Stats, gram, score, total
from barwright.plans.xsec import Groups, scalars

c_ = F.col


def factor_scores(df: DataFrame, cols: Sequence[str], y: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """IC, coverage and row count of every factor (per key), from one pass of three sums a column."""
    d = df.where(c_(y).isNotNull())
    x = {c: scrub(c) for c in cols}
    sums = [F.sum(c_(y) * c_(y)).alias("_yy"), F.count(F.lit(1)).alias("_n")]
    for c in cols:
        sums += [F.sum(x[c] * c_(y)).alias(f"_xy_{c}"), F.sum(x[c] * x[c]).alias(f"_xx_{c}"), F.sum((F.abs(x[c]) > 0).cast("long")).alias(f"_nz_{c}")]
    wide = d.groupBy(*keys).agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("factor"),
                              (c_(f"_xy_{c}") / F.sqrt(F.greatest(c_(f"_xx_{c}") * c_("_yy"), F.lit(1e-24)))).alias("ic"),
                              (c_(f"_nz_{c}") / c_("_n")).alias("coverage"), c_("_n").alias("n")) for c in cols])
    return wide.select(*keys, F.inline(rows))


def screen(df: DataFrame, cols: Sequence[str], y: str = "label", min_coverage: float = 0.3) -> DataFrame:
    return factor_scores(df, cols, y).where(c_("coverage") >= min_coverage)


def view_budget(scores: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Views allowed per factor by its place in the |IC| order (a table of factors)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs("ic").desc(), "factor")
    r = scores.withColumn("place", F.row_number().over(w))
    return r.select("factor", "ic", "place", F.explode(F.filter(
        F.array(*[F.when(c_("place") <= n, F.lit(v)) for v, n in budgets.items()]), lambda v: v.isNotNull())).alias("view"))


def yearly_score(df: DataFrame, cols: Sequence[str], y: str = "label") -> DataFrame:
    """|mean monthly IC| + .25 |overall| + .10 mean |IC| + .02 sign hits - .05 deviation."""
    months = factor_scores(df.withColumn("_month", F.date_format("datetime", "yyyy-MM")), cols, y, ["_month"])
    overall = factor_scores(df, cols, y).select("factor", c_("ic").alias("overall_ic"))
    m = months.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.avg(F.abs("ic")).alias("mean_abs_ic"), F.stddev_pop("ic").alias("std_ic"))
    ref = m.select("factor", F.when(F.signum("mean_ic") == 0, F.lit(1.0)).otherwise(F.signum("mean_ic")).alias("_s"))
    hit = months.join(ref, "factor").groupBy("factor").agg(F.avg((F.signum("ic") == c_("_s")).cast("double")).alias("sign_hit"))
    s = (F.abs("mean_ic") + F.lit(0.25) * F.abs("overall_ic") + F.lit(0.10) * c_("mean_abs_ic") + F.lit(0.02) * c_("sign_hit")
         - F.lit(0.05) * c_("std_ic"))
    return m.join(overall, "factor").join(hit, "factor").withColumn("score", s)


def correlation_long(df: DataFrame, cols: Sequence[str], y: str = "label") -> DataFrame:
    """Correlation matrix as rows, from one Gram aggregate."""
    s = gram(df, [], list(cols), y)
    k, pairs = len(cols), [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cov = lambda q, i, j: c_("g")[q] / c_("w") - c_("sx")[i] * c_("sx")[j] / (c_("w") * c_("w"))
    diag = {i: q for q, (i, j) in enumerate(pairs) if i == j}
    rows = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
                     F.try_divide(cov(q, i, j), F.sqrt(cov(diag[i], i, i) * cov(diag[j], j, j))).alias("corr")) for q, (i, j) in enumerate(pairs) if i < j]
    return s.select(F.inline(F.array(*rows)))


def greedy_decorrelate(stats: Stats, names: Sequence[str], limit: float = 0.9, min_ic: float = 1e-4, top: int | None = None) -> list[str]:
    """Keep a factor if its |corr| with every kept one is below the limit, best |IC| first."""
    ics = np.abs(stats.c) / np.sqrt(np.maximum(np.diag(stats.g) * stats.yy, 1e-24))
    corr, kept = np.abs(stats.corr()), []
    for j in np.argsort(-ics, kind="stable"):
        if ics[j] < min_ic or (top and len(kept) >= top):
            break
        if not kept or corr[j, kept].max() < limit:
            kept.append(int(j))
    return [names[j] for j in kept]


def ridge_weights(s: Stats, alpha: float) -> np.ndarray:
    return np.linalg.solve(s.g + alpha * np.eye(len(s.c)), s.c)


def ridge_stepwise(train: Stats, val: Stats, grid: Sequence[int], alpha: float) -> list[tuple[int, float]]:
    """Validation IC of ridge on the first k factors by |X'y|."""
    a, v = train.standardised(), val
    order = np.argsort(-np.abs(a.c), kind="stable")
    scale = np.where(train.std > 1e-12, train.std, 1.0)
    out = []
    for k in grid:
        idx = order[:k]
        w = ridge_weights(a.take(idx), alpha) / scale[idx]
        out.append((int(k), v.take(idx).ic(w)))
    return out


def leave_one_out(df: DataFrame, g: Groups, cols: Sequence[str], train: Column, alpha: float = 1.0, y: str = "label") -> DataFrame:
    """factor, base_ic, drop_ic, delta_ic, retained: what a ridge fit loses when a factor is left out, without refitting.

    Columns are standardised and their Gram matrix averaged over the training rows. Leaving factor j out moves the weights along column j of
    the inverse matrix. The IC is that of predictions z-scored within each timestamp, over the other rows. A factor is retained where
    the IC without it is lower.
    """
    cols = list(cols)
    s = Stats.of(gram(df.where(train), [], cols, y).head())
    scale = np.where(s.std > 1e-12, s.std, 1.0)
    z = (s.g / s.n - np.outer(s.mean, s.mean)) / np.outer(scale, scale)
    inverse = np.linalg.inv(z + alpha * np.eye(len(cols)))
    w = inverse @ ((s.c / s.n - s.mean * s.sy / s.n) / scale)
    fits = {"_all": w} | {f"_without_{k}": w - inverse[:, k] * (w[k] / inverse[k, k]) for k in range(len(cols))}
    rows = df.where(~train).where(c_(y).isNotNull() & reduce(lambda a, b: a & b, [c_(c).isNotNull() for c in cols]))
    rows = rows.select("datetime", y, *[score(cols, v / scale).alias(n) for n, v in fits.items()])
    rows = csz(rows, g, list(fits))
    ic = lambda n: F.sum(c_(n) * c_(y)) / F.sqrt(F.sum(c_(n) * c_(n)) * F.sum(c_(y) * c_(y)))
    one = rows.agg(*[ic(f"csz_{n}").alias(n) for n in fits])
    table = F.array(*[F.struct(F.lit(c).alias("factor"), c_("_all").alias("base_ic"), c_(f"_without_{k}").alias("drop_ic")) for k, c in enumerate(cols)])
    return one.select(F.inline(table)).withColumns({"delta_ic": c_("base_ic") - c_("drop_ic"), "retained": c_("drop_ic") < c_("base_ic")})


def noise_importance(df: DataFrame, cols: Sequence[str], weights: Sequence[float], y: str = "label", seed: int = 17) -> DataFrame:
    """IC lost when a column is replaced by Gaussian noise of its mean and deviation; one aggregate for all."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = df.transform(scalars(one)).withColumn("_p", score(cols, weights))
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm")
    d = d.withColumns({f"_q_{c}": c_("_p") + F.lit(float(w)) * (c_(f"_m_{c}") + c_(f"_s_{c}") * hash_normal(f"{seed}/{c}", "symbol", stamp) - c_(c))
                       for c, w in zip(cols, weights)})
    ic = lambda p: F.sum(c_(p) * c_(y)) / F.sqrt(F.sum(c_(p) * c_(p)) * F.sum(c_(y) * c_(y)))
    base = d.agg(ic("_p").alias("_b"), *[ic(f"_q_{c}").alias(f"_i_{c}") for c in cols])
    return base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), (c_("_b") - c_(f"_i_{c}")).alias("delta_ic")) for c in cols])))


def standalone(df: DataFrame, cols: Sequence[str], train, y: str = "label") -> DataFrame:
    """Train and validation IC of each component side by side."""
    t = factor_scores(df.where(train), cols, y).select("factor", c_("ic").alias("train_ic"))
    v = factor_scores(df.where(~train), cols, y).select("factor", c_("ic").alias("val_ic"))
    return t.join(v, "factor")


def greedy_forward(train: Stats, names: Sequence[str], size: int, penalty: float, seeds: Sequence[int] | None = None) -> list[str]:
    """Add the component with the best IC less a penalty on its mean |corr| with those chosen."""
    corr, best = np.abs(train.corr()), (-np.inf, [])
    single = train.c / np.sqrt(np.maximum(np.diag(train.g) * train.yy, 1e-24))
    for first in (seeds if seeds is not None else np.argsort(-np.abs(single))[:3]):
        chosen = [int(first)]
        while len(chosen) < min(size, len(names)):
            rest = [j for j in range(len(names)) if j not in chosen]
            value = []
            for j in rest:
                sub = train.take(chosen + [j])
                value.append(abs(sub.ic(ridge_weights(sub, 1e-6 * sub.n))) - penalty * corr[j, chosen].mean())
            chosen.append(rest[int(np.argmax(value))])
        sub = train.take(chosen)
        got = abs(sub.ic(ridge_weights(sub, 1e-6 * sub.n)))
        if got > best[0]:
            best = (got, chosen)
    return [names[j] for j in best[1]]


def component_rank(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """|weight| + 0.08 |standalone IC|, best first."""
    return (weights.join(scores, "factor").withColumn("rank_score", F.abs("weight") + F.lit(0.08) * F.abs("train_ic"))
            .orderBy(F.desc("rank_score"), "factor"))


def name_subset(names: DataFrame, suffix: str | None = None, prefix: str | None = None, has: str | None = None) -> DataFrame:
    d = names
    if suffix:
        d = d.where(c_("factor").endswith(suffix))
    if prefix:
        d = d.where(c_("factor").startswith(prefix))
    return d.where(c_("factor").contains(has)) if has else d


def top_features(delta: DataFrame, k: int | None = None) -> DataFrame:
    """Top k by IC change, or all that gain."""
    return delta.orderBy(F.desc("delta_ic"), "factor").limit(k) if k else delta.where(c_("delta_ic") > 0)
