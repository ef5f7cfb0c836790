"""Linear models: distributed sums, a k x k solve, and a column expression for the prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import clip
from barwright.operators import labels, sampling, views
from barwright.plans.moments import Stats, gram, score

c_ = F.col
Solved = tuple[np.ndarray, float]
Solver = Callable[[Stats], Solved]


# ---- solvers on statistics --------------------------------------------------------------------
def ridge(alpha: float, per_row: bool = False, intercept: bool = True, bound: float = 0.0, top_k: int = 0) -> Solver:
    """Standardised ridge. ``per_row`` scales the Gram by the weight sum before adding alpha."""

    def solve(s: Stats) -> Solved:
        z = s.standardised() if intercept else s
        k = len(z.c)
        idx = np.argsort(-np.abs(z.c), kind="stable")[:top_k] if top_k and top_k < k else np.arange(k)
        g, c = z.g[np.ix_(idx, idx)], z.c[idx]
        if per_row:
            g, c = g / s.w, c / s.w
        w = np.zeros(k)
        w[idx] = np.linalg.solve(g + alpha * np.eye(len(idx)), c)
        if bound:
            w = np.clip(w, -bound, bound)
        if not intercept:
            return w, 0.0
        w = w / np.where(s.std > 1e-12, s.std, 1.0)
        return w, float(s.sy / s.w - w @ s.mean)

    return solve


def project(w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Nearest point with sum one inside the bounds: bisection on the shift."""
    if lo.sum() > 1 + 1e-9 or hi.sum() < 1 - 1e-9:
        lo, hi = np.zeros_like(w), np.ones_like(w)
    even = w + (1.0 - w.sum()) / len(w)
    if np.all(even >= lo) and np.all(even <= hi):
        return even
    a, b = float((lo - w).min()) - 1.0, float((hi - w).max()) + 1.0
    for _ in range(50):
        m = (a + b) / 2
        if np.clip(w + m, lo, hi).sum() < 1:
            a = m
        else:
            b = m
    return np.clip(w + b, lo, hi)


def ic_weights(lo: float | Sequence[float] = 0.0, hi: float | Sequence[float] = 1.0, ridge_: float = 0.0, steps: int = 200,
               more: Sequence[Sequence[float]] = ()) -> Solver:
    """Sum-to-one weights inside bounds that maximise the IC: projected gradient ascent.

    ``more`` are further places to begin at, such as the weights of the month before. The ascent starts from the best place.

    Where the blend's covariance with the label is positive the score is quasi-concave, so one
    ascent from the best start suffices.
    """

    def solve(s: Stats) -> Solved:
        k = len(s.c)
        low = np.broadcast_to(np.asarray(lo, float), (k,)).copy()
        high = np.maximum(np.broadcast_to(np.asarray(hi, float), (k,)), 1.0 / k)
        g = s.g + ridge_ * np.trace(s.g) / k * np.eye(k)
        # the middle of the box, and the unbounded optimum among non-negative weights
        starts = [(low + high) / 2, best_direction(g, s.c)]
        starts += [np.asarray(v, float) for v in more]
        value = lambda w: float(w @ s.c) / np.sqrt(max(float(w @ g @ w), 1e-30) * max(s.yy, 1e-30))
        w = max((project(v, low, high) for v in starts), key=value)
        v, step = value(w), 0.5
        for _ in range(steps):
            q = max(float(w @ g @ w), 1e-30)
            grad = s.c / np.sqrt(q * s.yy) - float(w @ s.c) * (g @ w) / (q * np.sqrt(q * s.yy))
            n = float(np.abs(grad).max())
            if n < 1e-14 or step < 1e-7:
                break
            nxt = project(w + step * grad / n, low, high)
            nv = value(nxt)
            if nv > v:
                w, v, step = nxt, nv, min(step * 1.3, 0.5)
            else:
                step *= 0.4
        return w, 0.0

    return solve


def nonnegative(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least squares with non-negative weights, from the Gram matrix: min w'gw / 2 - c'w.

    An active set: the weight with the steepest gain enters, the free ones are solved together, and a solution that leaves the
    non-negative side is followed only up to the border, where the weight that reaches zero first goes.
    """
    k = len(c)
    w, free = np.zeros(k), np.zeros(k, bool)
    g = g + 1e-12 * max(float(np.trace(g)) / k, 1e-300) * np.eye(k)
    for _ in range(10 * k + 10):
        gain = np.where(free, -np.inf, c - g @ w)
        j = int(np.argmax(gain))
        if free.all() or gain[j] <= 1e-12 * max(float(np.abs(c).max()), 1e-300):
            break
        free[j] = True
        while True:
            full = np.zeros(k)
            full[free] = np.linalg.lstsq(g[np.ix_(free, free)], c[free], rcond=None)[0]
            under = free & (full <= 0)
            if not under.any():
                w = full
                break
            reach = np.where(under, w / np.maximum(w - full, 1e-300), np.inf)
            first = int(np.argmin(reach))
            w = w + reach[first] * (full - w)
            free[first] = False
            w[~free] = 0.0
            if not free.any():
                return w
    return w


def best_direction(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Non-negative weights of sum one with the highest c'w / sqrt(w'gw).

    That is the direction of the least-squares solution. If no weight gains anything, the score is largest in a corner; without any
    relation to the target (all c zero) the weights are equal.
    """
    k = len(c)
    w = nonnegative(g, c)
    if w.sum() > 0:
        return w / w.sum()
    if not np.any(c):
        return np.full(k, 1.0 / k)
    return np.eye(k)[int(np.argmax(c / np.sqrt(np.maximum(np.diag(g), 1e-18))))]


def simplex() -> Solver:
    """Non-negative weights of sum one with the best IC."""
    return lambda s: (best_direction(s.g / s.n, s.c / s.n), 0.0)


def equal() -> Solver:
    return lambda s: (np.full(len(s.c), 1.0 / len(s.c)), 0.0)


# ---- solving tables of statistics ----------------------------------------------------------------
def rolling_stats(stats: DataFrame, time: str, lookback: int, by: Sequence[str] = (), half_life: float | None = None, every: int = 1,
                  times: DataFrame | None = None) -> DataFrame:
    """Statistics of the ``lookback`` times before each time (0: all before), optionally decayed.

    With ``every``, for the first time and each that many later. ``times`` has all times that count, if ``stats`` may lack some.

    ``stats`` has one row per time (and group): a calendar-sized table. Arrays are summed position
    by position, so one task never holds more than one position's series.
    """
    by = list(by)
    t = (times if times is not None else stats).select(time).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(time)))  # times only
    flat = stats.withColumn("_v", F.concat(F.array(c_("n").cast("double"), "w", "sy", "yy"), "sx", "c", "g", F.array(F.size("sx").cast("double"))))
    cells = flat.join(t, time).select("_i", *by, F.posexplode("_v").alias("_p", "_x"))
    if lookback and (half_life or lookback <= 64):
        age = c_("_t") - c_("_i")
        f = F.pow(F.lit(0.5), (age - 1) / F.lit(float(half_life))) if half_life else F.lit(1.0)
        # only times that are asked for get a copy: lookback / every of them
        asked = F.filter(F.sequence(c_("_i") + 1, c_("_i") + lookback), lambda u: (u - 1) % every == 0)
        moved = cells.withColumn("_t", F.explode(asked))
        past = moved.groupBy("_t", *by, "_p").agg(F.sum(f * c_("_x")).alias("_x"), F.count(F.lit(1)).alias("_times"), F.max("_x").alias("_raw"))
    else:
        w = Window.partitionBy(*by, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding if not lookback else -lookback, -1)
        past = cells.select(c_("_i").alias("_t"), *by, "_p", F.sum("_x").over(w).alias("_x"), F.count("_x").over(w).alias("_times"), F.max("_x").over(w).alias("_raw"))
        past = past.where((c_("_t") - 1) % every == 0)
    packed = past.where("_times > 0").groupBy("_t", *by).agg(
        F.max("_times").alias("times"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("_v"),
        F.max_by("_raw", "_p").cast("int").alias("_k"))
    s = lambda a, n: F.slice("_v", a, n)
    return packed.join(t, packed["_t"] == t["_i"]).select(
        time, *by, "times", c_("_v")[0].alias("n"), c_("_v")[1].alias("w"), c_("_v")[2].alias("sy"), c_("_v")[3].alias("yy"),
        s(F.lit(5), c_("_k")).alias("sx"), s(5 + c_("_k"), c_("_k")).alias("c"), s(5 + 2 * c_("_k"), (c_("_k") * (c_("_k") + 1) / 2).cast("int")).alias("g"))


def solve_table(stats: DataFrame, keys: Sequence[str], solver: Solver) -> DataFrame:
    """One solve per row of statistics, inside the tasks: keys, n, weights, intercept, train_ic."""
    keys = list(keys)
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in stats.select(*keys).schema.fields)
    schema = fields + "n double, weights array<double>, intercept double, train_ic double"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                s = Stats.of(row)
                w, b = solver(s)
                rows.append({**{k: row[k] for k in keys}, "n": float(s.n), "weights": w, "intercept": b, "train_ic": s.ic(w)})
            yield pd.DataFrame(rows, columns=[*keys, "n", "weights", "intercept", "train_ic"])

    return stats.mapInPandas(run, schema)


def fold_table(stats: DataFrame, time: str, step: Callable[[Stats, Sequence[float] | None, dict], np.ndarray]) -> DataFrame:
    """One solve per time in order, each knowing the weights of the one before: time, times, weights.

    ``stats`` is calendar-sized, one small row per time; the rows stream in order through one task, which holds one at a time.
    """
    kind = dict(stats.dtypes)[time]

    def run(batches):
        last = None
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                last = [float(v) for v in step(Stats.of(row), last, row)]
                found.append({time: row[time], "times": int(row["times"]), "weights": last})
            yield pd.DataFrame(found, columns=[time, "times", "weights"])

    # one row per time: the order is the fold's, so a single partition
    return stats.coalesce(1).sortWithinPartitions(time).mapInPandas(run, f"{time} {kind}, times long, weights array<double>")


def dot(xs: Sequence[str], weights: str = "weights", intercept: str = "intercept") -> Column:
    out = c_(intercept)
    for i, x in enumerate(xs):
        out = out + c_(weights)[i] * c_(x)
    return out


def apply_table(df: DataFrame, table: DataFrame, keys: Sequence[str], xs: Sequence[str], out: str = "pred", default: Column | None = None) -> DataFrame:
    """Prediction from weights joined by key; rows without weights take the default."""
    d = df.join(table.select(*keys, "weights", "intercept"), list(keys), "left")
    return d.withColumn(out, F.coalesce(dot(xs), default) if default is not None else dot(xs)).drop("weights", "intercept")


# ---- models ------------------------------------------------------------------------------------
def fit(df: DataFrame, xs: Sequence[str], y: str, solver: Solver, weight: Column | None = None) -> Solved:
    return solver(Stats.of(gram(df, [], list(xs), y, weight).head()))


def weighted_ridge(df: DataFrame, train: Column, xs: Sequence[str], y: str = "label", alpha: float = 10.0, weight: Column | None = None,
                   top_k: int = 0, bound: float = 0.0, out: str = "pred") -> DataFrame:
    """Weighted standardised ridge; with a bound the z values are clipped, which takes a second pass."""
    if not bound:
        w, b = fit(df.where(train), xs, y, ridge(alpha, top_k=top_k), weight)
        return df.withColumn(out, score(xs, w, b))
    wt = weight if weight is not None else F.lit(1.0)
    sums = [e for x in xs for e in (F.sum(wt * c_(x)).alias(f"_a_{x}"), F.sum(wt * c_(x) * c_(x)).alias(f"_b_{x}"))]
    one = df.where(train).agg(F.sum(wt).alias("_w"), *sums).head()  # k sums
    z = {}
    for x in xs:
        m = one[f"_a_{x}"] / one["_w"]
        s = max(one[f"_b_{x}"] / one["_w"] - m * m, 0.0) ** 0.5
        z[f"_z_{x}"] = clip((c_(x) - F.lit(m)) / F.lit(s if s > 1e-12 else 1.0), -bound, bound)
    d = df.withColumns(z)
    w, b = fit(d.where(train), list(z), y, ridge(alpha, top_k=top_k), weight)
    return d.withColumn(out, score(list(z), w, b)).drop(*z)


def rank_gauss_ridge(df: DataFrame, train: Column, xs: Sequence[str], y: str = "label", alpha: float = 100.0, n: int = 201,
                     out: str = "pred") -> DataFrame:
    for x in xs:
        df = views.rank_gauss(df, x, train, n)
    cols = [f"{x}_rg" for x in xs]
    s = Stats.of(gram(df.where(train), [], cols, y).head())
    m = s.sy / s.w
    w = np.linalg.solve(s.g + alpha * np.eye(len(cols)), s.c - m * s.sx)
    return df.withColumn(out, score(cols, w, m)).drop(*cols)


def walk_forward(df: DataFrame, xs: Sequence[str], solver: Solver, y: str = "label", time: str = "month", lookback: int = 24,
                 min_rows: int = 5000, by: Sequence[str] = (), out: str = "pred", half_life: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Refit for every time on the times before it; months without enough history have no prediction."""
    past = rolling_stats(gram(df, [time, *by], list(xs), y), time, lookback, by, half_life).where(c_("n") >= min_rows)
    table = solve_table(past, [time, *by], solver)
    return apply_table(df, table, [time, *by], xs, out), table


def group_experts(df: DataFrame, xs: Sequence[str], solver: Solver, group: str, y: str = "label", time: str = "month", lookback: int = 24,
                  min_rows: int = 5000, min_group: int = 8000) -> DataFrame:
    """A model per group and time, the common model where a group has too few rows."""
    base, _ = walk_forward(df, xs, solver, y, time, lookback, min_rows, out="_common")
    stats = rolling_stats(gram(df, [time, group], list(xs), y), time, lookback, [group]).where(c_("n") >= min_group)
    return apply_table(base, solve_table(stats, [time, group], solver), [time, group], xs, "pred", c_("_common")).drop("_common")


def boosted_trees(df: DataFrame, train: Column, xs: Sequence[str], y: str = "label", cap: int = 100_000, seed: int = 11,
                  rounds: int = 20, depth: int = 3, rate: float = 0.1, out: str = "pred") -> DataFrame:
    """Gradient-boosted trees on a capped, hashed train sample, scored on every row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    va = VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="keep")
    src = sampling.cap_rows(df.where(train & c_(y).isNotNull()), cap, seed)
    gbt = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=out, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return gbt.fit(va.transform(src)).transform(va.transform(df)).drop("_x")


def residual_model(df: DataFrame, train: Column, base: str, xs: Sequence[str], y: str = "label", alpha: float = 10.0) -> DataFrame:
    """A model of what the base prediction leaves, on context features: beta of LB13, then ridge."""
    d = labels.residual_target(df, base, y, train)
    w, b = fit(d.where(train), xs, "residual", ridge(alpha))
    return d.withColumn("residual_pred", score(xs, w, b)).withColumn("pred", c_("beta") * c_(base) + c_("residual_pred"))


def linear_calibration(df: DataFrame, val: Column, xs: Sequence[str], y: str = "label", alpha: float = 1e-4, bound: float = 0.0,
                       out: str = "pred_cal") -> DataFrame:
    """Main and auxiliary outputs blended on validation rows; free intercept, clipped coefficients."""
    w, b = fit(df.where(val), xs, y, ridge(alpha, bound=bound))
    return df.withColumn(out, score(xs, w, b))
