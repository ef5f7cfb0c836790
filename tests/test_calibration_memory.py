"""Rolling quantiles, bucket scales, blends with memory and windows on a stride against plain Python."""

import datetime as dt

import numpy as np
import pytest

from barwright.operators import blend, calibrate, splits
from barwright.plans.rolling_quantiles import rolling_quantiles


def test_rolling_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(1, 9):
        rows += [(t, "a", float(v)) for v in rng.normal(0, 1, 300)] + [(t, "a", 0.25)] * 200       # a value that a third of the rows share
        rows += [(t, "b", float(v)) for v in 10.0 ** rng.uniform(-300, 300, 40) * rng.choice([-1, 1], 40)]
        rows += [(t, "b", v) for v in (None, float("nan"), float("inf"), float("-inf"), 0.0, 5e-324)]
        rows += [(t, "c", float(np.nextafter(1.0, 2.0) if k % 2 else 1.0)) for k in range(7)]     # neighbours among the doubles
    rows += [(30, "a", 1.0)]
    probs = {"a": [0.25, 0.5, 0.75], "b": [0.1, 0.9], "c": [0.0, 0.5, 1.0]}
    df = spark.createDataFrame(rows, "time int, part string, x double")
    got = {(r.time, r.part): (r.n, r.edges) for r in rolling_quantiles(df, 3, probs).collect()}
    want = {}
    for t in sorted({r[0] for r in rows}):
        for part, ps in probs.items():
            past = [x for u, q, x in rows if q == part and t - 3 <= u < t and x is not None and np.isfinite(x)]
            if past:
                want[t, part] = (len(past), list(np.quantile(past, ps)))
    assert got.keys() == want.keys() and (30, "a") not in got
    for k, (n, e) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], e, rtol=1e-12, atol=0)
    assert rolling_quantiles(df.where("false"), 3, probs).count() == 0


def test_rolling_keys_without_enough_history(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("s", t, m, v, 1.0) for m in (1, 2) for v in (-3.0, 1.0, 2.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, m int, p double, label double")
    got, cols = calibrate.rolling_keys(df, ["symbol", "conf2"], "p", "m", 5, least=1)
    assert cols == ["symbol", "conf2_key"] and {r.conf2_key for r in got.collect()} == {0}     # fewer than 100 a bin
    many = spark.createDataFrame(rows * 100, df.schema)
    got = {(r.m, r.p): r.conf2_key for r in calibrate.rolling_keys(many, ["symbol", "conf2"], "p", "m", 5, least=1)[0].where("p is not null and not isnan(p)").collect()}
    assert got == {(1, -3.0): 0, (1, 1.0): 0, (1, 2.0): 0, (2, -3.0): 1, (2, 1.0): 0, (2, 2.0): 1}


def _climb(a, b, n, yy, penalty, lo, hi):
    w = n / n.sum()
    value = lambda s: s @ a / np.sqrt((s * s @ b) * yy) - penalty * (w @ (s - 1) ** 2)
    s, step = np.ones(len(a)), 0.25
    while step > 1e-13:
        q = s * s @ b
        g = a / np.sqrt(q * yy) - (s @ a) * s * b / (q * np.sqrt(q * yy)) - 2 * penalty * w * (s - 1)
        t = np.clip(s + step * g / np.abs(g).max(), lo, hi)
        s, step = (t, min(step * 1.5, 0.25)) if value(t) > value(s) else (s, step / 2)
    return s, value


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_bucket_scales(spark, sign):
    rng = np.random.default_rng(5)
    key = rng.choice(6, 3000, p=[0.4, 0.2, 0.2, 0.1, 0.06, 0.04])
    p = rng.normal(0, 1, 3000)
    y = sign * p * (0.1 + 0.1 * key) + rng.normal(0, 1, 3000)
    rows = [(f"k{k}", float(a), float(b)) for k, a, b in zip(key, p, y)] + [("new", 1.0, None), (None, 2.0, 1.0), ("k0", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, label double")
    from pyspark.sql import functions as F
    got = {r.k: r for r in calibrate.bucket_scales(df, F.lit(True), "k", "p").dropDuplicates(["k"]).collect()}
    a, b, n = (np.array([v[key == k].sum() for k in range(6)]) for v in (p * y, p * p, np.ones(3000)))
    s, value = _climb(a, b, n, (y * y).sum(), 0.01, 0.7, 1.3)
    mine = np.array([got[f"k{k}"].scale for k in range(6)])
    assert value(mine) >= value(s) - 1e-12 and (sign < 0 or np.allclose(mine, s, atol=1e-4))
    assert got["new"].scale is None and got["new"].pred_cal == 1.0 and got[None].pred_cal == 2.0
    few = calibrate.bucket_scales(df, F.lit(True), "k", "p", min_rows=5000)
    assert few.where("scale <> 1").count() == 0 and few.count() == len(rows)


def test_blend_with_memory(spark):
    rng = np.random.default_rng(7)
    rows = []
    for m in range(1, 9):
        for _ in range(60):
            z, a, b, c = rng.normal(0, 1, 4).tolist()
            rows.append((f"2020-{m:02d}", z + a, (z + 2 * b) if m != 6 else None, (z + c) if m > 4 else 0.0, z if m < 8 else None))
    df = spark.createDataFrame(rows, "month string, a double, b double, c double, label double")
    out, table = blend.remembered_blend(df, ["a", "b", "c"], min_months=3)
    w = {r.month: np.array(r.weights) for r in table.collect()}
    assert len(w) == 8 and all(np.allclose(w[f"2020-{m:02d}"], 1 / 3) for m in (1, 2, 3))
    assert all(abs(v.sum() - 1) < 1e-9 and v.min() >= 0 and v.max() <= 0.9 + 1e-9 for v in w.values())
    assert w["2020-04"][2] == 0 and w["2020-05"][2] == 0            # nothing to go by yet
    assert w["2020-06"][1] == 0 and w["2020-06"][2] > 0             # not there in the month itself
    x = np.array([[v or 0.0 for v in r[1:4]] for r in rows])
    for m in (7, 8):                                                # month 8 has no labels but is scored
        past = [k for k, r in enumerate(rows) if r[0] < f"2020-{m:02d}"]
        y = np.array([rows[k][4] for k in past])
        ic = lambda v: (x[past] @ v) @ y / np.sqrt(((x[past] @ v) ** 2).sum() * (y * y).sum())
        grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(91) for j in range(91) if 10 <= i + j <= 100]
        assert ic(w[f"2020-{m:02d}"]) >= max(map(ic, grid)) - 1e-9
    assert out.where("pred is null").count() == 0 and out.count() == len(rows)


@pytest.mark.parametrize("length,stride", [(7, 3), (4, 9), (5, 5), (3, 1)])
def test_windows_on_a_stride(spark, length, stride):
    rows = []
    for s, n in (("big", 200), ("small", 5), ("one", 1)):
        for k in range(n):
            rows.append((s, k // 61, k % 61, k, float(k) if k % 11 else None, k % 4 > 0, "x"))
    df = spark.createDataFrame(rows, "symbol string, session_id long, session_pos long, bar_no long, v double, ok boolean, window_name string")
    from pyspark.sql import functions as F
    for scope, pos in (("session", "session_pos"), ("symbol", "bar_no")):
        on = F.col("ok") & (F.col(pos) % stride == 0)
        got = splits.strided_windows(df, ["v"], length, stride, F.col("ok"), scope)
        assert sorted(got.columns) == sorted([*df.columns, "window"])
        assert sorted(map(repr, _plain(got))) == sorted(map(repr, _plain(splits.materialise_windows(df, ["v"], length, on, scope))))


def _plain(d):
    return [(r.symbol, r.bar_no, r.v, r.ok, [x.v for x in r.window]) for r in d.collect()]
