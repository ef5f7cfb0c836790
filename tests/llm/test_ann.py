import numpy as np

from barwright.llm import ann


def table(spark, ids, vectors):
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")


def brute(ids, x, every=100, k=10):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def compare(df, want):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hit = total = 0
    assert got.keys() <= want.keys()
    for q, near in want.items():
        assert all(a <= b for a, b in zip([s for _, s in got.get(q, [])], [s for _, s in got.get(q, [])][1:]))
        scores = dict(got.get(q, []))
        hit += sum(i in scores and scores[i] == s for i, s in near)
        total += len(near)
        assert len(scores) == len(near)
    return hit / max(total, 1)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas()
    assert compare(ann.search(df), brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float))) >= 0.99


def test_blocks_ties_and_scales(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 20)) * 10 ** rng.uniform(-2, 2, (400, 1)) + 3
    x[50:200] = x[50]
    ids = rng.permutation(400) * 20
    assert compare(ann.search(table(spark, ids, x)), brute(ids, x)) >= 0.99


def test_odd_rows(spark):
    inf = float("inf")
    vectors = [[1, 0], [0, 1], [0, 0], None, [1, None], [float("nan"), 1], [inf, 1], [1, 1, 1], [1, 1, 2], [], [1, 0], [1, 0], [2, 0]]
    ids = [0, 1, 100, 200, 300, 400, 500, 600, 7, 8, 9, 9, None]
    got = [tuple(r) for r in ann.search(table(spark, ids, vectors)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 0.0), (0, 2, 1, np.sqrt(2)), (600, 1, 7, 1.0)]
    assert ann.search(table(spark, ids, vectors).limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, turn = rng.standard_normal((2000, 64)), ann.rotation(64)
    code, length, fit = ann.encode(x, turn)
    signs = (np.unpackbits(code, axis=1).astype(float) * 2 - 1) / np.sqrt(turn.shape[0])
    q = rng.standard_normal(64)
    estimate = signs @ (turn @ (q / np.linalg.norm(q))) / fit
    true = (x / length[:, None]) @ (q / np.linalg.norm(q))
    slack = ann.EPSILON * np.sqrt((1 - fit ** 2) / fit ** 2 / (turn.shape[0] - 1))
    assert (np.abs(estimate - true) <= slack).mean() > 0.99


def test_squares_out_of_range(spark):
    """Entries near 1e200 and 1e155 among plain vectors, and a table of entries near 1e-170: no row is lost."""
    rng = np.random.default_rng(2)
    for scale, few in ((1e200, 1), (1e155, 500), (1e-170, 500)):
        x = rng.standard_normal((500, 16))
        x[:few] *= scale
        ids = np.arange(500) * 10
        got = ann.search(table(spark, ids, x)).toPandas()
        assert len(got) == 50 * 10 and np.isfinite(got.score).all()
        q = np.flatnonzero(ids % 100 == 0)[3]
        big = np.abs(x).max()
        d = np.sqrt((((x - x[q]) / big) ** 2).sum(axis=1)) * big if few > 1 else np.sqrt(((x[1:] - x[q]) ** 2).sum(axis=1))
        want = np.sort(d)[1:11]
        assert np.allclose(got[got.query_id == ids[q]].sort_values("rank").score, want, rtol=1e-9, atol=0)


def test_share_reranked(spark, monkeypatch):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    centre, turn, seen = np.median(x, axis=0), ann.rotation(x.shape[1]), []
    code, length, fit = ann.encode(x - centre, turn)
    real = ann.lengths
    monkeypatch.setattr(ann, "lengths", lambda v: (seen.append(len(v)), real(v))[1])
    q = np.flatnonzero(ids % 100 == 0)
    list(ann.search_block(ids[q], x[q], ids, x, code, length, fit, centre, turn, 10))
    assert sum(seen) < 0.15 * len(q) * len(x)  # of 2,000 vectors; larger blocks rerank a smaller share
