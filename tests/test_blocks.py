"""Column blocks and the factor build against NumPy."""

import numpy as np
import pandas as pd
import pytest

from barwright.operators import build
from barwright.plans import blocks, xsec


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n, k = 900, 30
    base = rng.standard_normal((n, 6))
    x = base[:, rng.integers(0, 6, k)] + 0.4 * rng.standard_normal((n, k))
    x[:, 7] = 3.0                                   # constant
    x[:, 8] = np.where(rng.random(n) < 0.9, 0, x[:, 8])  # hardly covered
    x[rng.random(x.shape) < 0.05] = np.nan
    t = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    t.insert(0, "symbol", [f"s{i % 9}" for i in range(n)])
    t.insert(1, "datetime", pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) // 9, unit="D"))
    t.insert(2, "label", np.where(rng.random(n) < 0.1, np.nan, base[:, 0] + rng.standard_normal(n)))
    t.insert(3, "bar_no", np.arange(n) // 9)
    t.insert(4, "session_id", 0)
    rows = [[None if isinstance(v, float) and np.isnan(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r] for r in t.astype(object).values.tolist()]
    s = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, label double, bar_no long, session_id long, " + ", ".join(f"c{i} double" for i in range(k)))
    return t, s


META = ("symbol", "datetime", "label", "bar_no", "session_id")


def test_scores_and_correlated_pairs(frame, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 64)
    monkeypatch.setattr(blocks, "TILE", 7)
    t, s = frame
    names = [c for c in t.columns if c not in META]
    parts = [names[:11], names[11:20], names[20:]]
    made = [blocks.block_of(s.select(*META, *p), p, META) for p in parts]
    scores = [blocks.column_scores(b, "label") for b in made]
    lab = t[t.label.notna()]
    x, y = lab[names].fillna(0).to_numpy(), lab.label.to_numpy()
    flat = [v for p in scores for v in p]
    assert [v.name for v in flat] == names and {v.n for v in flat} == {len(lab)}
    assert np.allclose([v.ic for v in flat], x.T @ y / np.sqrt((x * x).sum(0) * (y @ y)))
    assert np.allclose([v.coverage for v in flat], (x != 0).mean(0)) and np.allclose([v.sd for v in flat], x.std(0))
    got = {(r.a, r.b): r["corr"] for r in blocks.correlated(made, scores, META[:2], "label", 0.5, len(lab)).collect()}
    corr = np.corrcoef(x.T)
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if abs(corr[i, j]) >= 0.5}
    assert set(got) == want and all(abs(got[p] - corr[p]) < 1e-9 for p in want)
    wide = blocks.together(made, [[p[2]] for p in parts], META[:2]).toPandas()
    assert len(wide) == len(t) and np.isclose(np.nansum(wide[parts[1][2]].astype(float)), np.nansum(t[parts[1][2]]))


def test_decorrelate_is_greedy():
    assert build.decorrelate([3, 0, 1, 2], [(0, 3), (1, 2), (0, 1)]) == [3, 1]
    assert build.decorrelate([0, 1, 2], []) == [0, 1, 2]


def test_build_keeps_what_is_not_correlated(frame, spark, tmp_path):
    t, s = frame
    names = [c for c in t.columns if c not in META]
    g = xsec.measure(s, ["datetime"])
    path = str(tmp_path / "views")
    chosen = build.factor_build([s.select(*META, *names[:13]), s.select(*META, *names[13:])], g, path, {"tsz_": 3, "csz_": 5, "csr_": 5}, META).toPandas()
    assert chosen.place.tolist() == list(range(1, len(chosen) + 1)) and (chosen.ic.abs().diff().dropna() <= 1e-12).all()
    assert "c8" not in set(chosen.name) and (chosen.coverage >= 0.3).all()
    back = spark.read.parquet(path).toPandas()
    assert set(chosen.name) <= set(back.columns) and len(back) == len(t)
    x = back.merge(t[["symbol", "datetime", "label"]], on=["symbol", "datetime"])
    x = x[x.label.notna()][chosen.name.tolist()].to_numpy(float)
    corr = np.abs(np.corrcoef(x.T)) - np.eye(len(chosen))
    assert corr.max() < 0.9
    raw = t[t.label.notna()][names].fillna(0)
    for c in set(names) - set(chosen.name) - {"c7", "c8"}:  # each raw column left out has a better one near it
        ic = abs(raw[c] @ t.label[raw.index] / np.sqrt((raw[c] @ raw[c]) * (t.label[raw.index] @ t.label[raw.index])))
        near = [abs(np.corrcoef(raw[c], x[:, k])[0, 1]) for k in range(len(chosen)) if abs(chosen.ic[k]) >= ic - 1e-9]
        assert max(near) >= 0.9 - 1e-9
