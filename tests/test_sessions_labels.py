"""Synthetic bars with known answers: breaks, labels, masks, contracts, causality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import factors, labels, sessions
from barwright.sources import bars as src


def minutes(start: str, n: int) -> list[dt.datetime]:
    t = dt.datetime.fromisoformat(start)
    return [t + dt.timedelta(minutes=i) for i in range(n)]


def frame(spark, parts: dict[str, list[dt.datetime]]):
    rows = [(s, t, *([float(i + 1)] * 4), 10.0, 20.0, 5.0) for s, ts in parts.items() for i, t in enumerate(ts)]
    pdf = pd.DataFrame(rows, columns=["symbol", "datetime", "open", "high", "low", "close", "volume", "amount", "oi"])
    return spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def panel(spark, parts, rows=64, bucket=3600, h=30):
    return labels.simple_label(sessions.add_sessions(frame(spark, parts), 60.0, bucket), h, rows).orderBy("symbol", "datetime").toPandas()


def test_short_break_is_chained(spark):
    p = panel(spark, {"X": minutes("2020-01-02 09:00", 75) + minutes("2020-01-02 10:30", 61)})
    at = p.set_index("datetime")
    now, then = at.loc["2020-01-02 10:00"], at.loc["2020-01-02 10:45"]
    assert abs(now["label"] - (then["close"] / now["close"] - 1)) < 1e-12
    assert p["label"].tail(30).isna().all() and p["label"].head(len(p) - 30).notna().all()
    assert not p["is_long_break_before"].any()


def test_long_break_cuts_labels(spark):
    p = panel(spark, {"Y": minutes("2020-01-03 09:00", 120) + minutes("2020-01-03 21:00", 41)})
    breaks = p[p["is_long_break_before"]]
    assert list(breaks["datetime"]) == [pd.Timestamp("2020-01-03 21:00")]
    assert p["label"].iloc[90:120].isna().all() and p["label"].iloc[:90].notna().all()
    assert p["bars_to_next_long_break"].iloc[119] == 0 and p["session_pos"].iloc[120] == 0


def test_buckets_and_chunks_do_not_change_results(spark):
    rng = np.random.default_rng(3)
    parts = {}
    for s in ("A", "B"):
        gaps = rng.choice([1, 1, 1, 2, 15, 90], size=400)
        parts[s] = [dt.datetime(2020, 1, 1) + dt.timedelta(minutes=int(m)) for m in np.cumsum(gaps)]
    a = panel(spark, parts, rows=31, bucket=600, h=7)
    b = panel(spark, parts, rows=10_000, bucket=10 ** 9, h=7)
    pd.testing.assert_frame_equal(a[b.columns], b)


def test_first_bar_counts_one(spark):
    p = sessions.add_sessions(frame(spark, {"Z": minutes("2020-01-01 09:00", 3) + minutes("2020-01-01 15:00", 2)}), 60.0, 3600)
    got = [r[0] for r in p.orderBy("datetime").select(sessions.bars_since_break()).collect()]
    assert got == [1, 2, 3, 0, 1]


def test_single_row_sessions(spark):
    p = panel(spark, {"W": [dt.datetime(2020, 1, d) for d in (1, 2, 3)]}, h=1)
    assert p["session_id"].tolist() == [0, 1, 2] and p["label"].isna().all()


def test_quality_contracts(spark):
    d = frame(spark, {"Q": minutes("2020-01-01 09:00", 20)})
    r = sessions.quality_report(d.unionByName(d.limit(1))).toPandas().iloc[0]
    assert r["duplicate_keys"] == 1 and r["off_minute"] == 0 and r["coverage_ok"]


def test_factors_see_no_future_and_no_chunk_edges(spark):
    rng = np.random.default_rng(5)
    ts = minutes("2020-01-01 09:00", 300)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    pdf = pd.DataFrame({"symbol": "C", "datetime": ts, "open": px, "high": px * 1.01, "low": px * 0.99, "close": px,
                        "volume": rng.uniform(1, 9, 300), "amount": rng.uniform(10, 90, 300), "oi": rng.integers(1, 50, 300) * 1.0})
    fams = ["mom", "sharpe", "bollz", "shape", "stoch", "activity_corr", "ema_diff", "macd", "drawdown", "extremes"]

    def run(p, rows):
        d = spark.createDataFrame(p).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
        f = factors.factor_panel(sessions.add_sessions(d, 60.0, 7200), fams, (5, 40), ((3, 13),), rows=rows)
        return f.orderBy("datetime").toPandas().drop(columns=["symbol", "datetime"])

    whole, cut = run(pdf, 10_000), run(pdf, 300)
    np.testing.assert_allclose(whole.to_numpy(float), cut.to_numpy(float), atol=1e-8, equal_nan=True)
    later = pdf.copy()
    later.loc[later.index[-1], ["open", "high", "low", "close", "volume"]] *= 3
    np.testing.assert_allclose(whole.to_numpy(float)[:-1], run(later, 300).to_numpy(float)[:-1], atol=1e-8, equal_nan=True)
    c = pdf["close"]
    ema = c.ewm(span=3, adjust=False).mean() - c.ewm(span=13, adjust=False).mean()
    np.testing.assert_allclose(whole["ema_diff_3_13"].to_numpy()[12:], (ema / (c.abs() + 1e-9)).to_numpy()[12:], atol=1e-9)
    lr = np.log(c / c.shift(1)).fillna(0.0)
    np.testing.assert_allclose(whole["skew_40"].to_numpy()[39:], lr.rolling(40).skew().to_numpy()[39:], atol=1e-6)
    np.testing.assert_allclose(whole["kurt_40"].to_numpy()[39:], lr.rolling(40).kurt().to_numpy()[39:], atol=1e-6)
    np.testing.assert_allclose(whole["maxret_40"].to_numpy()[39:], lr.rolling(40).max().to_numpy()[39:], atol=1e-12)


def test_vocabulary_size():
    mid, wins = len(factors.WINS_MID), len(factors.WINS)
    assert (wins, mid, len(factors.EMA_PAIRS), len(factors.LAG_BASES) * len(factors.LAGS)) == (21, 17, 10, 48)


def test_csv_loader(spark, tmp_path):
    (tmp_path / "ab.csv").write_text("Time,Open,High,Low,Close,Volume,Open Interest\n2020-01-02 09:00:30,1,2,0.5,1.5,x,7\n"
                                     "2020-01-02 09:00:59,9,9,9,9,9,9\n2020-01-02 09:01:00,2,3,1,2.5,4,8\n")
    (tmp_path / "cd.csv").write_text("datetime,close\n2020-01-02 09:00,5\n")
    got = src.read_csv_bars(spark, str(tmp_path / "*.csv"), 0.0).orderBy("symbol", "datetime").toPandas()
    assert got["symbol"].tolist() == ["AB", "AB", "CD"] and got["datetime"].dt.second.eq(0).all()
    assert got["oi"].tolist()[1] == 8.0 and got["amount"].tolist() == [0.0, 0.0, 0.0]
    assert src.discover_symbols(got_frame(spark, got), excluded=("CD",)).toPandas()["symbol"].tolist() == ["AB"]


def test_csv_loader_reads_every_header_and_keeps_the_first_of_a_key(spark, tmp_path):
    (tmp_path / "aa.csv").write_text("Time,Close\n2020-01-02 09:00,1\n2020-01-02 09:00,2\n2020-01-02 09:00,0\n")
    (tmp_path / "bb.csv").write_text("ts,o,h,l,c\n2020-01-02 09:00,1,2,3,4\n2020-01-02 09:01,1,2,3,4\n")
    got = src.read_csv_bars(spark, str(tmp_path / "*.csv")).orderBy("symbol", "datetime").collect()
    assert [(r.symbol, r.close) for r in got] == [("AA", 1.0), ("BB", None), ("BB", None)]
    (tmp_path / "cc.csv").write_text("")
    with pytest.raises(ValueError, match="1 of 3"):
        src.read_csv_bars(spark, str(tmp_path / "*.csv"))


def test_audit_survives_a_damaged_file(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "good"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "bad"))
    (part,) = (tmp_path / "bad").glob("part-*.parquet")
    data = bytearray(part.read_bytes())
    data[4:60] = bytes(56)
    part.write_bytes(data)
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    got = src.audit_files(spark, [str(tmp_path / n) for n in ("good", "bad", "none")], deep=True).collect()
    assert [(r.asset, r.readable) for r in got] == [("good", True), ("bad", False), ("none", False)]


def test_csv_loader_with_a_known_layout(spark, tmp_path):
    (tmp_path / "ef.csv").write_text("datetime,close\n2020-01-02 09:00,5\n2020-01-02 09:01,bad\n")
    got = src.read_csv_bars(spark, str(tmp_path / "*.csv"), columns=("datetime", "close")).orderBy("datetime").toPandas()
    assert got["symbol"].tolist() == ["EF", "EF"] and got["close"].tolist()[0] == 5.0 and np.isnan(got["close"].tolist()[1])


def got_frame(spark, pdf):
    return spark.createDataFrame(pdf[["symbol", "close"]])
