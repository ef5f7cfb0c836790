"""The size-safe paths against the plain ones, and the statistics layer against NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import blend, evaluate, factors, linear, memory, relational, sampling, select, sessions
from barwright.plans import moments, ordinal, staging, xsec
from barwright.plans.moments import Stats, gram


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 4000
    hot = np.where(rng.uniform(size=n) < 0.4, 0, rng.integers(1, 40, n))  # one timestamp holds 40 % of the rows
    pdf = pd.DataFrame({"symbol": [f"S{i}" for i in range(n)], "day": hot, "x": np.round(rng.normal(size=n), 2), "z": rng.normal(size=n)})
    pdf["datetime"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(pdf["day"], unit="D")
    pdf["label"] = 0.3 * pdf["x"] + rng.normal(size=n)
    pdf.loc[::17, "x"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    d = d.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, staging.stage(d, "test")


def test_rank_paths_agree_with_pandas(data):
    pdf, d = data
    for g in (xsec.Groups(("datetime",), 5000), xsec.Groups(("datetime",))):
        got = xsec.with_rank(d, g, "x", rank="r", pct="p").toPandas().set_index("symbol").loc[pdf["symbol"]]
        np.testing.assert_allclose(got["r"].to_numpy(), pdf.groupby("datetime")["x"].rank().to_numpy(), equal_nan=True)
        np.testing.assert_allclose(got["p"].to_numpy(), pdf.groupby("datetime")["x"].rank(pct=True).to_numpy(), equal_nan=True)


def test_stats_paths_agree(data):
    _, d = data
    a, b = (xsec.with_stats(d, g, {"m": F.avg("x"), "s": F.stddev_samp("x")}).orderBy("symbol").toPandas() for g in
            (xsec.Groups(("datetime",), 5000), xsec.Groups(("datetime",))))
    np.testing.assert_allclose(a[["m", "s"]].to_numpy(float), b[["m", "s"]].to_numpy(float), equal_nan=True)


def test_quantile_paths_agree_with_numpy(data):
    pdf, d = data
    probs = [0.0, 0.013, 0.25, 0.5, 0.72, 0.99, 1.0]
    want = np.nanquantile(pdf["x"], probs)
    for largest in (10_000, None):
        np.testing.assert_allclose(xsec.quantiles(d, [], "x", probs, largest).head()[0], want)
    by = xsec.quantiles(d, ["datetime"], "x", [0.5]).toPandas().set_index("datetime")["edges"].str[0].sort_index()
    np.testing.assert_allclose(by.to_numpy(), pdf.groupby("datetime")["x"].median().sort_index().to_numpy())


def test_ordinal_and_first_n(data):
    pdf, d = data
    o = ordinal.with_ordinal(d, ["datetime"], ["z"], F.floor(F.col("z") * 4), "i", "n").toPandas()
    want = pdf.set_index("symbol").groupby("datetime")["z"].rank() - 1
    assert (o.set_index("symbol")["i"] == want.loc[o["symbol"]]).all()
    got = sampling.cap_rows(d, 777, 5).toPandas()
    assert len(got) == 777 and set(got["symbol"]) == set(sampling.cap_rows(d.repartition(3), 777, 5).toPandas()["symbol"])
    per = ordinal.first_n(d, ["datetime"], sampling.draw(3), ["symbol"], 5).groupBy("datetime").count().toPandas()["count"]
    assert per.max() == 5


def test_weighted_draw_prefers_heavy_rows(data):
    _, d = data
    w = d.withColumn("event_score", F.when(F.col("z") > 0, 20.0).otherwise(0.0))
    got = sampling.first_n(w, [], sampling.weighted_draw(2, sampling.event_weight()), ["symbol"], 500, True).toPandas()
    assert (got["z"] > 0).mean() > 0.85


def test_gram_inline_blocks_and_numpy(data, monkeypatch):
    pdf, d = data
    d = d.where("x is not null")
    a = Stats.of(gram(d, [], ["x", "z"], "label").head())
    monkeypatch.setattr(moments, "INLINE_COLUMNS", 0)
    b = Stats.of(gram(d, [], ["x", "z"], "label").head())
    k = pdf.dropna()
    m = k[["x", "z"]].to_numpy()
    for s in (a, b):
        np.testing.assert_allclose(s.g, m.T @ m)
        np.testing.assert_allclose(s.c, m.T @ k["label"].to_numpy())
        assert s.n == len(k)
    by = gram(d, ["datetime"], ["x", "z"], "label").orderBy("datetime").collect()
    np.testing.assert_allclose(moments.total([Stats.of(r) for r in by]).g, m.T @ m)


def test_ridge_matches_numpy(data):
    pdf, d = data
    k = pdf.dropna()
    w, b = linear.fit(d.where("x is not null"), ["x", "z"], "label", linear.ridge(7.0))
    x = k[["x", "z"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 7 * np.eye(2), z.T @ (k["label"] - k["label"].mean()))
    np.testing.assert_allclose(w * x.std(0), want)
    np.testing.assert_allclose(b, k["label"].mean() - w @ x.mean(0))


def test_bounded_fits_beat_equal_weights():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.normal(size=(500, 4)) * [1, 2, 0.5, 1]
        y = x @ rng.uniform(0, 1, 4) + rng.normal(size=500)
        s = Stats(500, 500, x.sum(0), x.T @ y, x.T @ x, y.sum(), float(y @ y))
        w, _ = linear.ic_weights(0.0, 0.6)(s)
        assert abs(w.sum() - 1) < 1e-6 and w.min() > -1e-9 and w.max() < 0.6 + 1e-9
        assert s.ic(w) >= s.ic(np.full(4, 0.25)) - 1e-9
        v, _ = linear.simplex()(s)
        grid = max((s.ic(np.array([a, b, c, 10 - a - b - c]) / 10) for a in range(11) for b in range(11 - a) for c in range(11 - a - b)), default=0)
        assert s.ic(v) >= grid - 1e-9
        free, _ = linear.ic_weights(0.0, 1.0)(s)
        assert s.ic(free) >= s.ic(v) - 1e-3


def test_rolling_stats_paths_agree(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"month": np.repeat([f"2020-{m:02d}" for m in range(1, 11)], 30), "x": rng.normal(size=300), "label": rng.normal(size=300)})
    s = gram(spark.createDataFrame(pdf), ["month"], ["x"], "label")
    by = {k: float((v["x"] ** 2).sum()) for k, v in pdf.groupby("month")}
    months = sorted(by)
    for look in (3, 100):
        got = linear.rolling_stats(s, "month", look).toPandas().set_index("month")["g"].str[0]
        assert len(got) == 9
        for i, m in enumerate(months[1:], 1):
            assert abs(got[m] - sum(by[v] for v in months[max(0, i - look):i])) < 1e-9
    half = linear.rolling_stats(s, "month", 3, half_life=1.0).toPandas().set_index("month")["g"].str[0]
    assert abs(half["2020-04"] - (by["2020-03"] + by["2020-02"] / 2 + by["2020-01"] / 4)) < 1e-9


def test_leave_one_out_equals_refit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = x @ [1.0, 0.1, -4.0, 0.3] + rng.normal(size=400)
    cols, t = list("abcd"), np.arange(400) // 10
    pdf = pd.DataFrame(x, columns=cols).assign(label=y, datetime=pd.Timestamp("2020-01-01") + pd.to_timedelta(t, "D"), symbol=[f"S{k % 10}" for k in range(400)])
    df = spark.createDataFrame(pdf)
    got = select.leave_one_out(df, xsec.measure(df, ["datetime"]), cols, F.col("datetime") < "2020-01-25", 0.3).toPandas().set_index("factor")
    a, b = pdf[t < 24], pdf[t >= 24]

    def ic(keep):
        z, v = ((d[keep] - a[keep].mean()) / a[keep].std(ddof=0) for d in (a, b))
        w = np.linalg.solve(z.T @ z / len(z) + 0.3 * np.eye(len(keep)), z.T @ (a.label - a.label.mean()) / len(z))
        p = pd.Series(v @ w, b.index)
        p = p.groupby(b.datetime).transform(lambda q: (q - q.mean()) / (q.std() + 1e-8))
        return float(p @ b.label) / np.sqrt(float(p @ p) * float(b.label @ b.label))

    for c in cols:
        drop = ic([k for k in cols if k != c])
        assert abs(got.base_ic[c] - ic(cols)) < 1e-9 and abs(got.drop_ic[c] - drop) < 1e-9 and got.retained[c] == (drop < ic(cols))


def test_simplex_is_the_best_direction():
    rng = np.random.default_rng(3)
    for trial in range(60):
        k = int(rng.integers(1, 9))
        x = rng.normal(size=(50, k)) @ rng.normal(size=(k, k))
        g, c = x.T @ x, x.T @ rng.normal(size=50) - (30.0 if trial % 5 == 0 else 0.0)
        w = linear.best_direction(g, c)
        value = lambda v: float(v @ c) / np.sqrt(max(float(v @ g @ v), 1e-30))
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
        for v in [*rng.dirichlet(np.full(k, 0.4), 300), *np.eye(k)]:
            assert value(v) <= value(w) + 1e-7
    assert linear.best_direction(np.eye(3), np.zeros(3)).tolist() == [1 / 3] * 3


def test_event_tail_takes_the_highest_scores_of_any_scale(spark):
    for scale in (1.0, 1e6):
        d = spark.createDataFrame([(f"S{k % 7}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=k), float(k) * scale, (k % 11) / 11 - 0.5) for k in range(200)],
                                  "symbol string, datetime timestamp_ntz, event_score double, label_xrank double")
        got = sampling.event_tail(d, 20, 1, share=0.7).toPandas()
        assert len(got) == 20 and {k * scale for k in range(186, 200)} <= set(got["event_score"])


def test_duplicate_keys_are_refused_whatever_is_selected(spark):
    left = spark.createDataFrame([(1, 2)], "k long, v long")
    right = spark.createDataFrame([(1, 5, 6), (1, 7, 8)], "k long, a long, b long")
    for cols in (["a", "b"], ["b"], []):
        joined = relational.checked_left_join(left, right.select("k", *cols), ["k"])
        with pytest.raises(Exception, match="duplicate key"):
            joined.select("v", *cols[-1:]).collect()
    assert relational.checked_left_join(left, right.select("k").distinct(), ["k"]).count() == 1


def test_bootstrap_methods(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.1, 1, 300)
    s = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(days=k), float(v)) for k, v in enumerate(x)], "datetime timestamp_ntz, ic double")
    normal, blocks = (evaluate.bootstrap_ci(s, method=m, block=5).first() for m in ("normal", "blocks"))
    half = 1.96 * x.std(ddof=1) / np.sqrt(300)
    assert abs(normal.lo - (x.mean() - half)) < 1e-9 and abs(normal.hi - (x.mean() + half)) < 1e-9
    assert abs(blocks.lo - normal.lo) < 0.06 and abs(blocks.hi - normal.hi) < 0.06
    short = evaluate.bootstrap_ci(s.limit(10), block=20).first()
    assert (short.n, short.lo, short.hi) == (10, None, None)


def test_greedy_decorrelation():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 3))
    x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=1000)
    y = x[:, 0] + 0.5 * x[:, 2] + rng.normal(size=1000)
    s = Stats(1000, 1000, x.sum(0), x.T @ y, x.T @ x, y.sum(), float(y @ y))
    kept = select.greedy_decorrelate(s, ["a", "b", "c"], 0.9)
    assert len(kept) == 2 and "c" in kept


def test_ic_sanity(spark):
    d = spark.range(10_000).select(F.col("id"), F.randn(1).alias("y"), F.randn(2).alias("r")).withColumn("n", -F.col("y"))
    got = d.agg(evaluate.ic("y", "y").alias("a"), evaluate.ic("r", "y").alias("b"), evaluate.ic("n", "y").alias("c")).head()
    assert abs(got["a"] - 1) < 1e-12 and abs(got["b"]) < 0.05 and abs(got["c"] + 1) < 1e-12


def test_newey_west_and_tail(spark, data):
    rng = np.random.default_rng(8)
    x = rng.normal(0.1, 1, 200)
    pdf = pd.DataFrame({"datetime": pd.date_range("2020-01-01", periods=200), "ic": x})
    d = spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    xc = x - x.mean()
    v = (xc * xc).mean() + sum(2 * (1 - k / 6) * (xc[k:] * xc[:-k]).mean() for k in range(1, 6))
    assert abs(evaluate.newey_west(d).head()["t_stat"] - x.mean() / np.sqrt(v / 200)) < 1e-9
    pdf, d = data
    e = np.sort(((pdf["z"] - pdf["label"]) ** 2).to_numpy())[::-1]
    assert abs(evaluate.tail_mse(d, "z", "label", 0.1).head()[0] - e[:400].mean()) < 1e-9


def test_symbol_guard_sequence():
    rows = [{"symbol": s, "n": 500, "xy": a, "xx": b, "yy": 100.0} for s, a, b in (("A", -20.0, 90.0), ("B", 15.0, 100.0), ("C", -1.0, 50.0))]
    got = memory.guard_weights(rows, (0.0, 0.5, 1.0), 0.0, 100)
    assert [r[0] for r in got] == ["A", "C"] and got[0][1] == 0.0


def test_greedy_branches_gain():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = x[:, 0] + x[:, 1] + rng.normal(size=800)
    made = lambda x, y: Stats(len(y), len(y), x.sum(0), x.T @ y, x.T @ x, y.sum(), float(y @ y))
    groups = [made(x[k::4], y[k::4]) for k in range(4)]
    steps = blend.greedy_branches(groups, ["a", "b", "c"], (0.25, 0.5), start=0)
    assert steps[1][1] == "b" and steps[-1][3] > steps[0][3] and steps[1][4] == 4
    # in the last group the branch that pays elsewhere does harm: the gate keeps it out
    y[3::4] = x[3::4, 0] - x[3::4, 1]
    groups = [made(x[k::4], y[k::4]) for k in range(4)]
    loose = blend.greedy_branches(groups, ["a", "b", "c"], (0.1, 0.25), start=0)
    assert loose[1][1] == "b" and loose[1][6] < 0 and loose[1][4] == 3
    assert len(blend.greedy_branches(groups, ["a", "b", "c"], (0.1, 0.25), start=0, min_positive=4)) == 1
    assert all(s[1] != "b" for s in blend.greedy_branches(groups, ["a", "b", "c"], (0.1, 0.25), start=0, min_last=0.0))


def test_edge_search_in_one_and_two_levels(data):
    from barwright.functions.expr import edges_at_or_below, edges_below
    pdf, d = data
    for n in (5, 64, 65, 301):
        e = sorted(set(np.round(np.linspace(-2, 2, n), 2)))
        got = d.where("x is not null").select("x", edges_below("x", e).alias("l"), edges_at_or_below("x", e).alias("r")).toPandas()
        assert (got["l"] == np.searchsorted(e, got["x"], side="left")).all()
        assert (got["r"] == np.searchsorted(e, got["x"], side="right")).all()


def test_running_sum_and_codes(data):
    pdf, d = data
    r = ordinal.with_running_sum(d.withColumn("one", F.lit(2)), ["z"], F.floor(F.col("z") * 3), "one", "t").toPandas()
    assert (r.sort_values("z")["t"].to_numpy() == 2 * np.arange(1, len(pdf) + 1)).all()
    c = ordinal.with_codes(d.select("symbol"), "symbol", "code").toPandas()
    assert dict(zip(c["symbol"], c["code"])) == {s: i for i, s in enumerate(sorted(pdf["symbol"]))}


def test_cache_is_reused_only_for_the_same_description(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for meta, hit in (({"a": 1}, False), ({"a": 1}, True), ({"a": 2}, False)):
        df, found = staging.reuse(spark, "t", meta, build, str(tmp_path))
        assert found is hit and df.count() == 3
    assert len(calls) == 2


def test_bin_returns_paths_agree(data):
    _, d = data
    a, b = (evaluate.bin_returns(d, g, "x", "label", 10).orderBy("bin").toPandas() for g in (xsec.Groups(("datetime",), 5000), xsec.Groups(("datetime",))))
    pd.testing.assert_frame_equal(a, b)


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})()
    with pytest.raises(RuntimeError):
        staging.shared_dir(Fake())


def test_unique_visitors_on_a_stream(spark, tmp_path):
    from barwright.streaming import visitors
    src, out = str(tmp_path / "in"), "visits_out"
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-01 12:00:00", "b"), ("2024-01-02 09:00:00", "a")]
    d = spark.createDataFrame(rows, "ts string, ip string").select(F.col("ts").cast("timestamp").alias("ts"), "ip")
    d.write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    q = (visitors.first_visits(stream, "salt", "ip", "ts").writeStream.format("memory").queryName(out)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table(out).toPandas()
    assert len(got) == 3 and got["visitor"].nunique() == 2 and got["visitor"].str.len().eq(16).all()


def test_small_scales_are_kept(spark):
    """Returns near 1e-7, alone and after returns near 1e-2 in the same piece; constant frames stay NULL and zero."""
    rng, w, rows, want = np.random.default_rng(4), 13, [], {}
    small = rng.normal(size=80) * 1e-7
    series = {"a": small, "b": np.r_[rng.normal(size=120) * 1e-2, small, np.zeros(60)]}
    for name, lr in series.items():
        close = np.exp(np.cumsum(lr))
        lr = np.diff(np.log(close), prepend=np.nan)
        volume = 1e-9 * np.exp(rng.normal(size=len(lr)))
        for k, (c, v) in enumerate(zip(close, volume)):
            rows.append((name, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=k), *[float(c)] * 4, float(v), float(v), 1.0))
        p = pd.DataFrame({"lr": lr, "prev": np.r_[np.nan, lr[:-1]], "dn": np.where(lr < 0, lr * lr, 0.0)})
        typ = close * volume
        p["fu"], p["fd"] = (np.where(s * np.diff(close, prepend=close[0]) > 0, typ, 0.0) for s in (1, -1))
        f = p.rolling(w)
        want[name] = pd.DataFrame({"ac": [p.lr[i - w + 1:i + 1].corr(p.prev[i - w + 1:i + 1]) if i > w else np.nan for i in range(len(p))],
                                   "dvol": np.sqrt(f.dn.sum().clip(lower=0)), "mfi": 100 - 100 / (1 + f.fu.sum() / (f.fd.sum() + 1e-9))})
    bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, oi double")
    panel = sessions.add_sessions(bars, gap_minutes=60)
    got = factors.factor_panel(panel, ["autocorr", "downside", "mfi"], (w,), keep=("symbol", "datetime")).orderBy("symbol", "datetime").toPandas()
    for name in series:
        g, e = got[got.symbol == name].reset_index(drop=True), want[name]
        part = slice(20, 80) if name == "a" else slice(140, 200)
        np.testing.assert_allclose(g[f"ret_ac1_{w}"].to_numpy(float)[part], e.ac.to_numpy()[part], atol=2e-2 if name == "b" else 1e-6)
        np.testing.assert_allclose(g[f"dvol_{w}"].to_numpy(float)[part], e.dvol.to_numpy()[part], rtol=1e-2 if name == "b" else 1e-6)
        np.testing.assert_allclose(g[f"mfi_{w}"].to_numpy(float)[part], e.mfi.to_numpy()[part], rtol=1e-6)
    flat = got[got.symbol == "b"].iloc[-40:]
    assert flat[f"ret_ac1_{w}"].isna().all() and (flat[f"dvol_{w}"] == 0).all()
