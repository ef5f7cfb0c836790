"""Bar contract, whole timestamps and the candidate guard against plain Python."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barwright.operators import memory, sampling, sessions


def test_order_is_checked_across_stretches(spark):
    rng = np.random.default_rng(0)
    start, rows, falls, last = dt.datetime(2020, 1, 1), [], {}, {}
    for k in range(5000):
        s, t = f"s{rng.integers(0, 4)}", k if rng.random() < 0.98 else k - 50
        if s == "s3":
            t = k
        falls[s] = falls.get(s, 0) + (t < last.get(s, t))
        last[s] = t
        rows.append((s, start + dt.timedelta(minutes=int(t)), 1.0, f"f{k // 2000}", k % 2000))
    bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, close double, file string, row long").repartition(1).sortWithinPartitions("file", "row")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
        got = {r.symbol: r.falls for r in sessions.order_report(bars, ("file", "row")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == falls and falls["s3"] == 0 and falls["s0"] > 0


def test_bar_contract(spark):
    t = dt.datetime(2020, 1, 1)
    good = [("a", t + dt.timedelta(minutes=k), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(4)]
    bad = [("b", t.replace(microsecond=5), 1.0, 1.0, 1.0, None, 1.0, None, 1.0), ("b", t.replace(microsecond=5), 1.0, 1.0, 1.0, None, 1.0, None, None)]
    names = "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, oi double"
    bars = spark.createDataFrame(good + bad, names)
    a, b = sorted(sessions.bar_contract(bars).collect(), key=lambda r: r.symbol)
    assert a.holds and a.missing_columns == "" and (a.n_rows, a.duplicate_keys, a.off_minute, a.off_second) == (4, 0, 0, 0)
    assert not b.holds and (b.duplicate_keys, b.off_second, b.close_share, b.amount_share, b.oi_share) == (1, 1, 0.0, 0.0, 0.5)
    less = sessions.bar_contract(bars.drop("oi", "open")).collect()
    assert not any(r.holds for r in less) and {r.missing_columns for r in less} == {"open,oi"}


def ic(p, y):
    return float(p @ y / np.sqrt((p @ p) * (y @ y)))


@pytest.mark.parametrize("options", [{}, {"rescale": True}, {"ic_lte": None, "ic_gte": 0.0, "max_symbols": 4}, {"min_group": 0.02, "min_full": 1e-3}])
def test_candidate_guard(spark, options):
    rng = np.random.default_rng(4)
    n = 3000
    t = pd.DataFrame({"symbol": [f"s{k:02d}" for k in rng.integers(0, 14, n)], "val": rng.random(n) < 0.6, "label": rng.standard_normal(n)})
    skill = dict(zip(sorted(t.symbol.unique()), rng.uniform(-0.3, 0.3, 14)))
    t["p"] = t.label * t.symbol.map(skill) + rng.standard_normal(n)
    t["q"], t["r"] = t.label * 0.1 + 3 * rng.standard_normal(n) + 1, -t.p + rng.standard_normal(n)
    grid, args = sorted({0.0, -0.5, 0.25, 0.5}), {"ic_lte": 0.02, "ic_gte": None, "max_symbols": 0, "rescale": False, "min_group": 0.0, "min_full": 0.0} | options
    df = spark.createDataFrame(t)
    chosen = memory.candidate_guard(df, df.val, "p", ["r", "q"], (-0.5, 0.25, 0.5), min_count=120, **args)
    got = {r.symbol: (r.candidate, r.weight, r.ic_after) for r in chosen.collect()}
    v = t[t.val]
    cur, y = v.p.to_numpy().copy(), v.label.to_numpy()
    own = {s: ic(cur[m], y[m]) for s in sorted(v.symbol.unique()) for m in [(v.symbol == s).to_numpy()] if m.sum() >= 120}
    able = [s for s, c in own.items() if (args["ic_lte"] is not None and c <= args["ic_lte"]) or (args["ic_gte"] is not None and c >= args["ic_gte"])]
    able = sorted(able, key=lambda s: own[s], reverse=args["ic_lte"] is None)[:args["max_symbols"] or None]
    want, after = {}, t.p.to_numpy().copy()
    for s in able:
        m, base, best = (v.symbol == s).to_numpy(), ic(cur, y), None
        for name in ("q", "r"):
            c, whole = v[name].to_numpy()[m], t[name].to_numpy()
            if args["rescale"]:
                whole = (whole - c.mean()) / c.std() * cur[m].std() + cur[m].mean()
                c = (c - c.mean()) / c.std() * cur[m].std() + cur[m].mean()
            for w in grid:
                trial = cur.copy()
                trial[m] = (1 - w) * cur[m] + w * c
                g, f = ic(trial[m], y[m]), ic(trial, y)
                if g >= own[s] + args["min_group"] and f >= base + args["min_full"] and (best is None and f > base + 1e-12 or best and f > best[0]):
                    best = (f, name, w, trial, whole)
        if best and best[2]:
            cur = best[3]
            want[s] = (best[1], best[2], best[0])
            rows = (t.symbol == s).to_numpy()
            after[rows] = (1 - best[2]) * after[rows] + best[2] * best[4][rows]
    assert want and got.keys() == want.keys()
    for s in want:
        assert got[s][:2] == want[s][:2] and abs(got[s][2] - want[s][2]) < 1e-10
    full = memory.apply_candidate_guard(df.withColumn("k", df.label), chosen, "p", ["q", "r"]).select("k", "pred").toPandas().sort_values("k")
    assert np.allclose(full.pred, after[np.argsort(t.label)])


def test_whole_timestamps_fill_the_budget(spark):
    rng = np.random.default_rng(2)
    sizes = {dt.datetime(2020, 1, 1) + dt.timedelta(days=d): int(n) for d, n in enumerate(rng.integers(1, 60, 80))}
    df = spark.createDataFrame([(f"s{k}", d) for d, n in sizes.items() for k in range(n)], "symbol string, datetime timestamp_ntz")
    order = sampling.hash_uniform(7, sampling.F.date_format("datetime", "yyyy-MM-dd HH:mm"))
    walk = [r.datetime for r in df.select("datetime").distinct().orderBy(order, "datetime").collect()]
    for budget in (1, 100, 777, 10 ** 6):
        used, want = 0, set()
        for d in walk:
            if sizes[d] >= 5 and (not want or used + sizes[d] <= budget):
                want.add(d)
                used += sizes[d]
        got = {r.datetime for r in sampling.whole_timestamps(df, budget, 5, 7).select("datetime").distinct().collect()}
        assert got == (set(sizes) if budget >= sum(sizes.values()) else want)
