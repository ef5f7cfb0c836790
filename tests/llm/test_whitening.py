import numpy as np
import pytest

from barwright.llm import polar, queries, whitening

FOLDER = "/root/testdata/sf0.1"


def brute(vectors, most=16):
    """(n, deviation of each row, whitened up to sign, explained) with NumPy's eigenvalue solver, sums in Python integers."""
    x = [[int(np.floor(64.0 * float(c))) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, deviation, (np.array(x) - mean) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64, 130])
def test_leading_eigenvectors(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d + 2, d)) * rng.uniform(0.01, 30, d)
    a = x.T @ x
    e, v = polar.leading(a, min(16, d))
    want = np.linalg.eigvalsh(a)[::-1][:len(e)]
    assert np.allclose(e, want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 and np.linalg.norm(a @ v - v * e) < 1e-13 * np.linalg.norm(a) * np.sqrt(d)


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(5), np.diag([3.0, 1, 2]), np.ones((6, 6)), np.diag([1e12, 1.0, 1e-12]),
                               np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]])), np.array([[2.0, 0, 1], [0, 2, 0], [1, 0, 2]])])
def test_ties_and_singular_matrices(a):
    e, v = polar.leading(a, len(a))
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * max(np.linalg.norm(a), 1e-300))
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13 and np.linalg.norm(a @ v - v * e) <= 1e-13 * np.linalg.norm(a)


def test_polar_factor():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for smallest in (1e-2, 1e-8, 1e-14):
        value = np.r_[np.geomspace(smallest, 1, 20), -np.geomspace(smallest, 1, 20)]
        assert np.linalg.norm(polar.polar((q * value) @ q.T) - (q * np.sign(value)) @ q.T) < 1e-13 / smallest


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    t = df.toPandas()
    n, deviation, whitened, explained = brute(t.embedding)
    got = queries.op11_embedding_whitening(spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    assert (got.n == n).all() and len(got) == 16 * len(t) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    order = np.argsort(t.vec_id.to_numpy())
    assert got.deviation[got.component == 1].tolist() == [deviation[i] for i in order]
    z = got.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((z * whitened[order]).sum(axis=0))
    assert np.abs(z * sign - whitened[order]).max() < 1e-8
    assert np.allclose(got.explained.to_numpy()[:16], explained, rtol=1e-10)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, dim int, x string")


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(5)
    plain = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(40)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 2.0]), (53, [1.0, inf, 2.0]), (54, []), (None, [0.0, 0.0, 0.0]), (3, plain[3][1]),
           (60, [1.0, 2.0]), (61, [1.0, 2.0]), (62, [1.0, 5.0])]
    got = whitening.whiten(table(spark, plain + odd)).collect()
    three = [v for _, v in plain] + [[0.0, 0.0, 0.0]]
    n, deviation, whitened, explained = brute(three + [plain[3][1]])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {*range(40), None, 60, 61, 62} and len(by[3]) == 6 and len(by[None]) == 3
    assert {r.n for i in range(40) for r in by[i]} == {n} == {41}
    for k in range(40):
        rows = sorted(by[k], key=lambda r: r.component)[:: len(by[k]) // 3]
        assert int(rows[0].deviation) == deviation[k]
        assert np.allclose(np.abs([r.whitened for r in rows]), np.abs(whitened[k]), atol=1e-9)
    # two distinct vectors that differ in one entry: one component has a spread
    two = sorted(by[62], key=lambda r: r.component)
    assert [r.n for r in two] == [2, 2] and abs(two[0].whitened) == 1.0 and two[1].whitened is None
    assert two[0].explained == 1.0 and two[1].explained == 0.0 and two[0].identity_error == 0.0


def test_no_spread_and_empty(spark):
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got] == [(1, None, None, None, 0)] * 4
    assert whitening.whiten(table(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_huge_entries(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 12 and all(r.deviation is None for r in got)
    assert all(abs(r.whitened) < 4 if r.component == 1 else r.whitened is None for r in got)  # the second is within rounding of zero
    middle = [(i, [1e9 * i, 0.5]) for i in range(4)]
    want = brute([v for _, v in middle], 1)[1]
    got = whitening.whiten(table(spark, middle), 1).orderBy("vec_id").collect()
    assert [int(r.deviation) for r in got] == want


def test_order_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a, b = (whitening.whiten(d).toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)
            for d in (df, df.repartition(13).orderBy(df.vec_id.desc())))
    exact = ["vec_id", "component", "n", "deviation"]
    assert a[exact].equals(b[exact]) and np.allclose(a.explained, b.explained, rtol=1e-13)
    assert np.abs(a.whitened - b.whitened).max() < 1e-12  # products of a block may be added in another order
