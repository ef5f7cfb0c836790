"""Blending component predictions: grids, bounded fits, rolling and grouped weights, stacks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.expr import clip, minute_of_day, scrub
from barwright.operators import linear, relational, views
from barwright.plans import xsec
from barwright.plans.moments import Stats, add_up, gram, score, total
from barwright.plans.xsec import Groups
from barwright.plans.xsec import scalars

c_ = F.col


def component_signal(df: DataFrame, g: Groups, x: str, mode: str, out: str) -> DataFrame:
    """raw, centred rank share, or cross-sectional z."""
    if mode == "raw":
        return df.withColumn(out, c_(x))
    d = views.csr(df, g, [x], "_v_") if mode == "rank" else views.csz(df, g, [x], 1e-9, "_v_")
    return d.withColumn(out, c_(f"_v_{x}")).drop(f"_v_{x}")


def month_stats(df: DataFrame, xs: Sequence[str], y: str = "label", month: str = "month") -> DataFrame:
    return gram(df, [month], xs, y)


# ---- grids --------------------------------------------------------------------------------------
def _cell(k: int, i: int, j: int) -> int:
    """Place of (i, j) in the flattened upper triangle."""
    a, b = min(i, j), max(i, j)
    return a * k - a * (a - 1) // 2 + b - a


def blend_ic(k: int, w: Sequence[Column]) -> Column:
    """IC of a blend from statistics: w'c / sqrt(w'Gw * y'y)."""
    num = sum((w[i] * c_("c")[i] for i in range(k)), F.lit(0.0))
    q = sum((w[i] * w[j] * c_("g")[_cell(k, i, j)] for i in range(k) for j in range(k)), F.lit(0.0))
    return F.try_divide(num, F.sqrt(F.when(q * c_("yy") > 1e-24, q * c_("yy"))))


def weight_grid(stats: DataFrame, k: int, step: float = 0.1, cap: float = 1.0, total_max: float | None = None) -> DataFrame:
    """Every weight vector on the grid with its IC, one row each, from rows of statistics.

    Weights sum to one, or to at most ``total_max`` when it is given. The grid's size depends on
    k and the step only.
    """
    units, top = int(round(1.0 / step)), int(round((total_max if total_max is not None else 1.0) / step))
    limit = int(round(cap / step + 1e-9))
    d = stats.withColumns({"_u": F.array().cast("array<int>"), "_left": F.lit(top)})
    free = k if total_max is not None else k - 1
    for _ in range(free):
        d = (d.withColumn("_x", F.explode(F.sequence(F.lit(0), c_("_left"))))
             .withColumns({"_u": F.concat("_u", F.array("_x")), "_left": c_("_left") - c_("_x")}).drop("_x"))
    if total_max is None:
        d = d.withColumn("_u", F.concat("_u", F.array("_left")))
    d = d.where(F.array_max("_u") <= limit).withColumn("weights", F.transform("_u", lambda v: v / F.lit(float(units))))
    return d.withColumn("ic", blend_ic(k, [c_("weights")[i] for i in range(k)])).drop("_u", "_left")


def best_grid_weight(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best grid point per key; equal scores go to the smallest weights in order."""
    best = F.max_by("weights", F.struct("ic", F.transform("weights", lambda v: -v)))
    return grid.groupBy(*keys).agg(best.alias("weights"), F.max("ic").alias("ic"))


def closed_weights(stats: DataFrame, k: int, rule: str) -> DataFrame:
    """equal, top-1, or proportional to the positive standalone IC."""
    ics = [F.try_divide(c_("c")[i], F.sqrt(c_("g")[_cell(k, i, i)] * c_("yy"))) for i in range(k)]
    eq = F.array(*[F.lit(1.0 / k)] * k)
    if rule == "equal":
        w = eq
    elif rule == "top1":
        arr = F.array(*ics)
        w = F.array(*[(F.array_position(arr, F.array_max(arr)) == i + 1).cast("double") for i in range(k)])
    else:
        pos = [F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) for v in ics]
        s = sum(pos, F.lit(0.0))
        w = F.when(s > 0, F.array(*[F.try_divide(p, s) for p in pos])).otherwise(eq)
    return stats.withColumn("weights", w)


def apply_weights(df: DataFrame, table: DataFrame, keys: Sequence[str], xs: Sequence[str], out: str = "pred") -> DataFrame:
    """Weights joined by key (or a single row of them) and applied as one projection."""
    w = table.select(*keys, "weights")
    d = df.join(w, list(keys), "left") if keys else df.transform(scalars(w))
    return d.withColumn(out, sum((c_("weights")[i] * c_(x) for i, x in enumerate(xs)), F.lit(0.0))).drop("weights")


def fit_apply(df: DataFrame, train: Column, xs: Sequence[str], solver: linear.Solver, y: str = "label", time_minutes: int | None = None,
              out: str = "pred") -> DataFrame:
    """Fit, flip the sign if the train IC is negative, optionally calibrate by part of the day."""
    from barwright.operators import calibrate
    s = Stats.of(gram(df.where(train), [], xs, y).head())
    w, _ = solver(s)
    w = -w if s.ic(w) < 0 else w
    d = df.withColumn(out, score(xs, w))
    return calibrate.sequential(d, train, out, [("time", time_minutes)], out) if time_minutes else d


def rolling_blend(df: DataFrame, xs: Sequence[str], y: str = "label", month: str = "month", lookback: int = 0, min_months: int = 24,
                  lo: float = 0.0, hi: float = 0.9, anchor: str | None = None, anchor_min: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Bounded IC weights from the months strictly before; equal weights while history is short.

    Components that do not vary in the history get no weight.
    """
    floor = [max(lo, anchor_min if x == anchor else 0.0) for x in xs]
    cap = [max(hi, f) for f in floor]

    def solve(s: Stats):
        live = np.flatnonzero(s.std > 1e-10)
        live = live if len(live) else np.arange(len(xs))
        w = np.zeros(len(xs))
        w[live] = linear.ic_weights([floor[i] for i in live], [cap[i] for i in live])(s.take(live))[0]
        return w, 0.0

    past = linear.rolling_stats(gram(df, [month], xs, y), month, lookback).where(c_("times") >= min_months)
    table = linear.solve_table(past, [month], solve)
    eq = sum((c_(x) / F.lit(float(len(xs))) for x in xs), F.lit(0.0))
    return linear.apply_table(df, table, [month], xs, "pred", eq), table


def remembered_blend(df: DataFrame, xs: Sequence[str], y: str = "label", month: str = "month", lookback: int = 0, min_months: int = 24,
                     lo: float = 0.0, hi: float = 0.9, anchor: str | None = None, anchor_min: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Bounded IC weights from the months strictly before, each month starting from the weights of the month before it.

    A component takes part in a month if its values vary both in that month and in some month of the look-back (all take part if
    none does). Months count whether labelled or not; missing components are 0, rows without a label enter no sum. With fewer than
    ``min_months`` months before, weights are equal.
    """
    filled = df.withColumns({x: scrub(x) for x in xs})
    spread = filled.groupBy(month).agg(F.array(*[F.coalesce(F.stddev_pop(x), F.lit(0.0)) for x in xs]).alias("spread"))
    order = Window.orderBy(month)  # months only
    back = order.rowsBetween(-lookback if lookback else Window.unboundedPreceding, -1)
    before = spread.select(month, "spread", F.count(F.lit(1)).over(back).alias("times"),
                           F.array(*[F.coalesce(F.max(c_("spread")[i]).over(back), F.lit(0.0)) for i in range(len(xs))]).alias("past"))
    k = len(xs)
    sizes = {"sx": k, "c": k, "g": k * (k + 1) // 2}
    zero = {n: F.coalesce(n, F.lit(0.0)) for n in ("n", "w", "sy", "yy")} | {
        n: F.coalesce(n, F.array_repeat(F.lit(0.0), size)) for n, size in sizes.items()}
    # a month without labels still has a place in the order
    stats = spread.select(month).join(gram(filled, [month], xs, y), month, "left").withColumns(zero)
    past = before.join(linear.rolling_stats(stats, month, lookback).drop("times"), month, "left").withColumns(zero)

    def step(s: Stats, last: Sequence[float] | None, row: dict) -> np.ndarray:
        if row["times"] < min_months:
            return np.full(k, 1.0 / k)
        live = np.flatnonzero((np.asarray(row["spread"]) > 1e-10) & (np.asarray(row["past"]) > 1e-10))
        live = live if len(live) else np.arange(k)
        floor = [max(lo, anchor_min if xs[i] == anchor else 0.0) for i in live]
        cap = [max(hi, 1.0 / len(live), f) for f in floor]
        w = np.zeros(k)
        # corners matter where every blend goes against the label: the score is then best at an end
        more = [np.where(np.arange(len(live)) == j, cap, floor) for j in range(len(live))] + ([] if last is None else [[last[i] for i in live]])
        w[live] = linear.ic_weights(floor, cap, more=more)(s.take(live))[0]
        return w

    table = linear.fold_table(past, month, step)
    return apply_weights(filled, table, [month], xs), table


def rolling_grid_blend(df: DataFrame, xs: Sequence[str], y: str = "label", month: str = "month", lookback: int = 12, step: float = 0.1) -> DataFrame:
    """Best grid weights of every month from the months before it."""
    past = linear.rolling_stats(gram(df, [month], xs, y), month, lookback)
    return best_grid_weight(weight_grid(past, len(xs), step), [month])


# ---- alpha between two predictions --------------------------------------------------------------
def alpha_grid(moments: DataFrame, steps: int = 21) -> DataFrame:
    """IC of (1 - a) * p + a * q over a grid, from moments pp, pq, qq, py, qy, yy."""
    d = moments.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("alpha", c_("_k") / F.lit(float(steps - 1)))
    a = c_("alpha")
    b = F.lit(1.0) - a
    q = b * b * c_("pp") + F.lit(2.0) * a * b * c_("pq") + a * a * c_("qq")
    return d.withColumn("ic", (b * c_("py") + a * c_("qy")) / F.sqrt(F.greatest(q * c_("yy"), F.lit(1e-30)))).drop("_k")


def pair_moments(df: DataFrame, keys: Sequence[str], p: str, q: str, y: str = "label") -> DataFrame:
    m = {"pp": (p, p), "pq": (p, q), "qq": (q, q), "py": (p, y), "qy": (q, y), "yy": (y, y)}
    d = df.where(c_(p).isNotNull() & c_(q).isNotNull() & c_(y).isNotNull())
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c_(a) * c_(b)).alias(k) for k, (a, b) in m.items()])


def best_alpha(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.groupBy(*keys).agg(F.max_by("alpha", F.struct("ic", -c_("alpha"))).alias("alpha"), F.max("ic").alias("ic"))


def residual_grid(moments: DataFrame, weights: Sequence[float]) -> DataFrame:
    """IC of p + w * q for each weight, from the same moments."""
    d = moments.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    w = c_("weight")
    q = c_("pp") + F.lit(2.0) * w * c_("pq") + w * w * c_("qq")
    return d.select("weight", ((c_("py") + w * c_("qy")) / F.sqrt(F.greatest(q * c_("yy"), F.lit(1e-30)))).alias("ic"))


def rolling_alpha(df: DataFrame, p: str, q: str, by: Sequence[str] = (), y: str = "label", month: str = "month", lookback: int = 12,
                  min_rows: int = 5000, steps: int = 21, default: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Mixing weight per month (and group) from the months before it."""
    by = list(by)
    t = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    d = df.withColumn("_t", t)
    cells = pair_moments(d, ["_t", *by], p, q, y).withColumn("_t", F.explode(F.sequence(c_("_t") + 1, c_("_t") + lookback)))
    past = cells.groupBy("_t", *by).agg(*[F.sum(s).alias(s) for s in ("n", "pp", "pq", "qq", "py", "qy", "yy")]).where(c_("n") >= min_rows)
    table = best_alpha(alpha_grid(past, steps), ["_t", *by])
    j = d.join(table.select("_t", *by, "alpha"), ["_t", *by], "left").withColumn("alpha", F.coalesce("alpha", F.lit(default)))
    return j.withColumn("pred", (F.lit(1.0) - c_("alpha")) * c_(p) + c_("alpha") * c_(q)).drop("_t"), table


def static_alpha(df: DataFrame, val: Column, p: str, q: str, y: str = "label", steps: int = 41, out: str = "pred") -> DataFrame:
    one = best_alpha(alpha_grid(pair_moments(df.where(val), [], p, q, y), steps), []).select(c_("alpha").alias("_a"))
    return df.transform(scalars(one)).withColumn(out, (F.lit(1.0) - c_("_a")) * c_(p) + c_("_a") * c_(q)).withColumnRenamed("_a", "alpha")


# ---- groups and buckets -------------------------------------------------------------------------
def group_gate(df: DataFrame, train: Column, xs: Sequence[str], group: str, alpha: float = 0.5, min_rows: int = 80_000, y: str = "label",
               lo: float = 0.0, hi: float = 0.8) -> DataFrame:
    """Global and group weights mixed by alpha; small groups keep the global ones."""
    stats = gram(df.where(train), [group], xs, y)
    solver = linear.ic_weights(lo, hi)
    base, _ = solver(Stats.of(add_up(stats, [], len(xs)).head()))
    table = linear.solve_table(stats.where(c_("n") >= min_rows), [group], lambda s: ((1 - alpha) * base + alpha * solver(s)[0], 0.0))
    return linear.apply_table(df, table, [group], xs, "pred", score(xs, base))


def bucketed_mixture(df: DataFrame, train: Column, xs: Sequence[str], buckets: Sequence[str], shrink: float = 5000.0, y: str = "label") -> DataFrame:
    """Weights per bucket shrunk to the global ones by n / (n + shrink)."""
    stats = gram(df.where(train), list(buckets), xs, y)
    solver = linear.ic_weights()
    base, _ = solver(Stats.of(add_up(stats, [], len(xs)).head()))

    def solve(s: Stats):
        a = s.n / (s.n + shrink)
        return a * solver(s)[0] + (1 - a) * base, 0.0

    return linear.apply_table(df, linear.solve_table(stats, list(buckets), solve), list(buckets), xs, "pred", score(xs, base))


def daily_mixture(df: DataFrame, xs: Sequence[str], y: str = "label", lookback: int = 60, half_life: float = 20.0, every: int = 5,
                  min_days: int = 20, lo: float = 0.0, hi: float = 0.9, solver: linear.Solver | None = None) -> DataFrame:
    """Weights refit every few days on decayed statistics of the days before; equal while history is short."""
    day = F.date_format("datetime", "yyyy-MM-dd")
    d = df.withColumn("_day", day)
    past = linear.rolling_stats(gram(d, ["_day"], xs, y), "_day", lookback, half_life=half_life, every=every, times=d)
    past = past.where(c_("times") >= min_days)
    # days between refits reuse the last refit; numbering runs over days only
    days = d.select("_day").distinct().withColumn("_i", F.row_number().over(Window.orderBy("_day")) - 1)
    table = linear.solve_table(past, ["_day"], solver or linear.ic_weights(lo, hi))
    refit = days.withColumn("_at", c_("_i") - c_("_i") % every)
    table = refit.join(days.select(c_("_i").alias("_at"), c_("_day").alias("_fit")), "_at").join(
        table.withColumnRenamed("_day", "_fit"), "_fit").select("_day", "weights", "intercept")
    eq = sum((c_(x) / F.lit(float(len(xs))) for x in xs), F.lit(0.0))
    return linear.apply_table(d, table, ["_day"], xs, "pred", eq).drop("_day")


def daily_stack_ridge(df: DataFrame, xs: Sequence[str], y: str = "label", lookback: int = 60, min_days: int = 20, alpha: float = 10.0) -> DataFrame:
    """Ridge refit each day on the prior days."""
    return daily_mixture(df, xs, y, lookback, None, 1, min_days, solver=linear.ridge(alpha))


# ---- weighting schemes --------------------------------------------------------------------------
def scheme_weight(stats: DataFrame, scheme: str, month: str = "month", half_life: float = 6.0) -> Column:
    """Row weights on month statistics: row (1), month-equal (1/n), month-decay."""
    if scheme == "row":
        return F.lit(1.0)
    if scheme == "month_equal":
        return F.lit(1.0) / c_("n")
    last = stats.agg(F.max(month)).head()[0]
    age = F.lit(int(last[:4]) * 12 + int(last[5:7])) - (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int"))
    return F.pow(F.lit(0.5), age / F.lit(half_life)) / c_("n")


def weighted_stats(stats: DataFrame, scheme: str, k: int, month: str = "month", half_life: float = 6.0) -> DataFrame:
    return add_up(stats, [], k, scheme_weight(stats, scheme, month, half_life))


def embargoed_gate(df: DataFrame, train: Column, xs: Sequence[str], embargo: int, y: str = "label", lo: float = 0.0, hi: float = 0.8) -> DataFrame:
    """Static gate fit on train rows less the last bars of each symbol, applied everywhere."""
    last = df.where(train).groupBy("symbol").agg(F.max("bar_no").alias("_last"))
    src = df.where(train).join(last, "symbol").where(c_("bar_no") <= c_("_last") - embargo)
    w, _ = linear.fit(src, xs, y, linear.ic_weights(lo, hi))
    return df.withColumn("pred", score(xs, w))


def gate_grid(stats: Sequence[Stats], names: Sequence[str], subsets: dict[str, Sequence[int]], bounds: Sequence[tuple[float, float]],
              ridges: Sequence[float]) -> list[tuple[str, float, float, float, float, float]]:
    """Blocked cross-validation of subset x bounds x ridge on fold statistics (total less the fold)."""
    whole, out = total(stats), []
    for name, idx in subsets.items():
        for lo, hi in bounds:
            for r in ridges:
                ics = []
                for fold in stats:
                    w, _ = linear.ic_weights(lo, hi, r)((whole - fold).take(idx))
                    ics.append(fold.take(idx).ic(w))
                out.append((name, lo, hi, r, float(np.mean(ics)), float(np.min(ics))))
    return sorted(out, key=lambda row: (-row[4], -row[5], row[0], row[1], row[3]))


def view_stack(df: DataFrame, train: Column, xs: Sequence[str], choose: str = "", y: str = "label", lo: float = -0.2, hi: float = 0.8) -> DataFrame:
    """Stack the view columns whose name holds ``choose``: standardise, bounded fit, apply."""
    cols = [x for x in xs if choose in x]
    s = Stats.of(gram(df.where(train), [], cols, y).head())
    w, _ = linear.ic_weights(lo, hi)(s.standardised())
    w = w / np.where(s.std > 1e-12, s.std, 1.0)
    return df.withColumn("pred", score(cols, w, float(-w @ s.mean)))


def rolling_stack(df: DataFrame, xs: Sequence[str], target: str = "label", month: str = "month", lookback: int = 12, min_rows: int = 1000) -> DataFrame:
    """Month by month bounded stack on standardised statistics, against a raw, z or rank target."""

    def solve(s: Stats):
        w, _ = linear.ic_weights(-0.2, 0.8)(s.standardised())
        w = w / np.where(s.std > 1e-12, s.std, 1.0)
        return w, float(-w @ s.mean)

    return linear.walk_forward(df, xs, solve, target, month, lookback, min_rows)[0]


def market_overlay(df: DataFrame, g: Groups, train: Column, xs: Sequence[str], p: str, alphas: Sequence[float], gammas: Sequence[float],
                   y: str = "label") -> tuple[DataFrame, DataFrame]:
    """Ridge of the mean label on per-timestamp component moments and the calendar, added with weight gamma."""
    per = df.groupBy("datetime").agg(*[e for x in xs for e in (F.avg(x).alias(f"m_{x}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s_{x}"))], F.avg(y).alias("_y"))
    tau, d, mo = F.lit(2.0) * F.pi(), F.weekday("datetime"), F.month("datetime")
    per = per.withColumns({"dow_sin": F.sin(tau * d / F.lit(7.0)), "dow_cos": F.cos(tau * d / F.lit(7.0)), "mon_sin": F.sin(tau * mo / F.lit(12.0)),
                           "mon_cos": F.cos(tau * mo / F.lit(12.0))})
    feats = [f"{a}_{x}" for x in xs for a in "ms"] + ["dow_sin", "dow_cos", "mon_sin", "mon_cos"]
    s = Stats.of(gram(per.where(train), [], feats, "_y").head())
    over = per
    for i, a in enumerate(alphas):
        w, b = linear.ridge(a, per_row=True)(s)
        over = over.withColumn(f"over_{i}", score(feats, w, b))
    j = df.join(over.select("datetime", *[f"over_{i}" for i in range(len(alphas))]), "datetime", "left")
    combos = [(i, k, a, gm) for i, a in enumerate(alphas) for k, gm in enumerate(gammas)]
    ic = lambda v: F.try_divide(F.sum(v * c_(y)), F.sqrt(F.sum(v * v) * F.sum(c_(y) * c_(y))))
    grid = j.where(train).agg(*[ic(c_(p) + F.lit(gm) * c_(f"over_{i}")).alias(f"ic_{i}_{k}") for i, k, a, gm in combos])
    rows = grid.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("alpha"), F.lit(float(gm)).alias("gamma"), c_(f"ic_{i}_{k}").alias("ic"))
                                          for i, k, a, gm in combos])))
    best = rows.agg(F.max_by(F.struct("i", "gamma"), F.struct("ic", -c_("i"), -c_("gamma"))).alias("_b"))
    pick = F.element_at(F.array(*[c_(f"over_{i}") for i in range(len(alphas))]), c_("_b.i") + 1)
    out = j.transform(scalars(best)).withColumn("pred", c_(p) + c_("_b.gamma") * pick)
    return out.drop("_b", *[f"over_{i}" for i in range(len(alphas))]), rows


def gate_features(df: DataFrame, train: Column, xs: Sequence[str], bound: float = 8.0) -> DataFrame:
    """Row-wise mean, deviation, mean |.|, maximum and minimum of the standardised components."""
    one = df.where(train).agg(*[e for x in xs for e in (F.avg(x).alias(f"_m_{x}"), F.stddev_pop(x).alias(f"_s_{x}"))])
    z = F.array(*[clip((F.coalesce(c_(x), F.lit(0.0)) - c_(f"_m_{x}")) / (c_(f"_s_{x}") + F.lit(1e-6)), -bound, bound) for x in xs])
    k = F.lit(float(len(xs)))
    d = df.transform(scalars(one)).withColumn("_z", z)
    total_ = lambda f: F.aggregate("_z", F.lit(0.0), lambda a, v: a + f(v))
    d = d.withColumns({"gate_mean": total_(lambda v: v) / k, "gate_abs": total_(F.abs) / k, "gate_max": F.array_max("_z"), "gate_min": F.array_min("_z"),
                       "_sq": total_(lambda v: v * v) / k})
    return (d.withColumn("gate_std", F.sqrt(F.greatest(c_("_sq") - c_("gate_mean") * c_("gate_mean"), F.lit(0.0))))
            .drop("_z", "_sq", *one.columns))


# ---- branch selection ---------------------------------------------------------------------------
def greedy_branches(groups: Sequence[Stats], names: Sequence[str], grid: Sequence[float], start: int = 0, min_delta: float = 1e-4, max_steps: int = 5,
                    min_positive: int = 0, max_decline: float = -np.inf, min_last: float = -np.inf) -> list[tuple]:
    """(step, candidate, weight, ic, positive_groups, min_group_delta, last_group_delta): from a start branch, mix in what gains most.

    ``groups`` are statistics of the validation groups in order (months, say); they add up to the whole, so a trial gives its IC and its gain in every
    group without reading rows. A trial counts if at least ``min_positive`` groups gain (or all there are), none loses more than ``max_decline`` allows and
    the last gains ``min_last``. Steps end where the best stable trial gains less than ``min_delta``. A candidate is mixed in once.
    """
    whole, order = total(groups), sorted(range(len(names)), key=lambda j: names[j])
    w = np.zeros(len(names))
    w[start] = 1.0
    steps, used = [(0, names[start], 1.0, float(whole.ic(w)), 0, 0.0, 0.0)], {start}
    while len(steps) <= max_steps:
        now, before = whole.ic(w), np.array([s.ic(w) for s in groups])
        best = (now, None)
        for j in (j for j in order if j not in used):
            for a in grid:
                trial = (1 - a) * w
                trial[j] += a
                gain = np.array([s.ic(trial) for s in groups]) - before
                stable = (gain > 0).sum() >= min(min_positive, len(gain)) and gain.min() >= max_decline and gain[-1] >= min_last
                if stable and (v := whole.ic(trial)) > best[0]:
                    best = (v, (j, a, trial, gain))
        if best[1] is None or best[0] < now + min_delta:
            break
        j, a, w, gain = best[1]
        used.add(j)
        steps.append((len(steps), names[j], float(a), float(best[0]), int((gain > 0).sum()), float(gain.min()), float(gain[-1])))
    return steps


def cross_section_blend(df: DataFrame, g: Groups, val: Column, p: str, mode: str, grid: Sequence[float], y: str = "label", min_delta: float = 0.0) -> DataFrame:
    """Mix in the cross-sectional z or unit rank of a prediction with the best grid weight, if it pays."""
    if mode == "rank":
        d = views.csr_unit(df, g, p, "_cs")
    else:
        d = views.csz(df, g, [p], None, "_cs_").withColumn("_cs", F.coalesce(f"_cs_{p}", F.lit(0.0))).drop(f"_cs_{p}")
    d = views.rescale_to_reference(d, "_cs", p, val, "_cs")
    m = pair_moments(d.where(val), [], p, "_cs", y)
    t = m.withColumn("w", F.explode(F.array(*[F.lit(float(v)) for v in dict.fromkeys([0.0, *grid])])))
    b = F.lit(1.0) - c_("w")
    q = b * b * c_("pp") + F.lit(2.0) * c_("w") * b * c_("pq") + c_("w") * c_("w") * c_("qq")
    t = t.withColumn("ic", (b * c_("py") + c_("w") * c_("qy")) / F.sqrt(F.greatest(q * c_("yy"), F.lit(1e-30))))
    one = t.agg(F.max_by("w", F.struct("ic", -F.abs("w"))).alias("_w"), F.max("ic").alias("_best"), F.max(F.when(c_("w") == 0, c_("ic"))).alias("_base"))
    one = one.select(F.when(c_("_best") >= c_("_base") + F.lit(min_delta), c_("_w")).otherwise(0.0).alias("cs_weight"))
    return d.transform(scalars(one)).withColumn("pred", (F.lit(1.0) - c_("cs_weight")) * c_(p) + c_("cs_weight") * c_("_cs")).drop("_cs")


# Names of the candidate sets with their views and how many components, the rules, and the calibrated ones with (minutes, alpha)
CATALOG_SETS = (("raw3", ("raw",), 3), ("xcenter3", ("xcenter",), 3), ("xsz3", ("xsz",), 3), ("xrank3", ("xrank",), 3), ("rankgauss3", ("rankgauss",), 3),
                ("tanh3", ("tanh",), 3), ("raw_xsz6", ("raw", "xsz"), 3), ("xsz_rank6", ("xsz", "xrank"), 3), ("best_raw2", ("raw",), 2),
                ("best_xsz2", ("xsz",), 2), ("best_rank2", ("rankgauss",), 2))
CATALOG_RULES = ("equal", "top1", "icpos", "simplex", "signed_ridge_a001", "signed_ridge_a01", "signed_ridge_a1")
CALIBRATED_SETS = ("raw3", "raw_xsz6", "best_raw2")
CALIBRATED_RULES = ("equal", "simplex", "signed_ridge_a001", "signed_ridge_a01", "signed_ridge_a1")
CALIBRATIONS = ((60, 0.25), (90, 0.25), (120, 0.25), (120, 0.5))


def candidate_catalog(scores: DataFrame, name: str = "factor", score: str = "train_ic") -> DataFrame:
    """candidate, feature_set, rule, calibration, columns: every set of component columns with every rule, and calibrated variants of some.

    Components are the names of a score table, best |score| first (ties by name), so sets of two hold the two best. A table of names: 137 rows.
    """
    best = scores.agg(F.array_sort(F.collect_list(F.struct((-F.abs(score)).alias("_s"), c_(name).alias("name")))).alias("_b")).select(c_("_b")["name"].alias("_c"))

    def suffixed(view: str):
        return lambda x: F.concat(x, F.lit("" if view == "raw" else f"_{view}"))

    def columns(views_: Sequence[str], most: int) -> Column:
        return F.concat(*[F.transform(F.slice("_c", 1, most), suffixed(v)) for v in views_])

    sets = best.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature_set"), columns(v, k).alias("columns")) for n, v, k in CATALOG_SETS])))
    literals = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    plain = sets.withColumn("rule", literals(CATALOG_RULES)).withColumn("calibration", F.lit(""))
    calibrated = (sets.where(c_("feature_set").isin(*CALIBRATED_SETS)).withColumn("rule", literals(CALIBRATED_RULES))
                  .withColumn("calibration", literals([f"time{m}_a{a:g}" for m, a in CALIBRATIONS])))
    d = plain.unionByName(calibrated)
    return d.select(F.concat_ws("__", "feature_set", "rule", F.when(c_("calibration") != "", c_("calibration"))).alias("candidate"),
                    "feature_set", "rule", "calibration", "columns")


def outer_harness(df: DataFrame, sets: dict[str, Sequence[str]], solvers: dict[str, linear.Solver], folds: Sequence[tuple[str, str]], audit_from: str,
                  y: str = "label", month: str = "month") -> list[tuple[str, str, float]]:
    """Candidates x folds on month statistics: fit before the fold, score in it, then one audit at the end."""
    cols = list(dict.fromkeys(c for v in sets.values() for c in v))
    rows = {r[month]: Stats.of(r) for r in gram(df, [month], cols, y).toLocalIterator()}  # one row a month
    pick = lambda lo, hi: [s for m, s in rows.items() if lo <= m < hi]
    out = []
    for name, xs in sets.items():
        idx = [cols.index(x) for x in xs]
        for rule, solver in solvers.items():
            for a, b in [*folds, (audit_from, "9999-12")]:
                fit, test = pick("0000-00", a), pick(a, b)
                if fit and test:
                    w, _ = solver(total(fit).take(idx))
                    out.append((f"{name}__{rule}", "audit" if a == audit_from else a, total(test).take(idx).ic(w)))
    return out


def family_combinations(s: Stats, val: Stats, names: Sequence[str], families: dict[str, Sequence[str]], lo: float = 0.0, hi: float = 0.8) -> list[tuple[str, float]]:
    """One member of each family, every combination: bounded weights on train, IC on validation."""
    from itertools import product
    out = []
    for combo in product(*families.values()):
        idx = [list(names).index(c) for c in combo]
        w, _ = linear.ic_weights(lo, hi)(s.take(idx))
        out.append(("+".join(combo), float(val.take(idx).ic(w))))
    return sorted(out, key=lambda r: (-r[1], r[0]))
