"""Whitening: Jacobi-Davidson against dense eigenvectors, the whole operator against its formula, odd inputs."""
import numpy as np
import pytest

from matchlake.llm import whitening


def brute(rows):
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    d = max((len(v) for _, v in good), default=0)
    good = [(i, v) for i, v in good if len(v) == d]
    x = np.array([[int(np.floor(64 * float(e))) + 1_000_000 for e in v] for _, v in good], np.int64)
    n = len(x)
    y = n * x - x.sum(axis=0)
    c = y / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], n, (y ** 2).sum(axis=1), c, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d,wanted,decay", [(12, 32, 1.0), (64, 32, 0.99), (300, 20, 0.97), (300, 32, 0.999)])
def test_pairs_equal_dense_ones(d, wanted, decay):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    want = 50.0 * decay ** np.arange(d)
    v = (basis * want) @ basis.T
    passes = []
    values, u = whitening.jacobi_davidson(lambda b: passes.append(1) or v @ b, d, wanted)
    k = min(d, wanted)
    assert np.allclose(values, want[:k], rtol=1e-12) and len(passes) < 400
    assert np.abs(v @ u - u * values).max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    if decay < 0.999:
        assert np.abs(np.abs((u * basis[:, :k]).sum(axis=0)) - 1).max() < 1e-9


def test_tied_and_zero_values():
    v = np.diag([5.0] * 10 + [1.0] * 10 + [0.0] * 20)
    values, u = whitening.jacobi_davidson(lambda b: v @ b, 40, 15)
    assert np.allclose(values, [5.0] * 10 + [1.0] * 5) and np.abs(v @ u - u * values).max() < 1e-12
    values, _ = whitening.jacobi_davidson(lambda b: 0 * b, 40, 3)
    assert np.allclose(values, 0)


def test_minres_solves_each_column():
    rng = np.random.default_rng(2)
    a = np.diag(np.concatenate((np.linspace(-3, -1, 10), np.linspace(1, 4, 20))))
    right, shift = rng.standard_normal((30, 4)), np.array([0.1, 0.2, -0.3, 0.0])
    t = whitening.minres(lambda p: a @ p - p * shift, right, 30, 1e-12)
    assert np.abs(a @ t - t * shift - right).max() < 1e-8


def compared(spark, rows, parts=3, components=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, x string, n int").repartition(parts)
    got = whitening.whitened(df, components=components).toPandas()
    ids, n, deviation, c, e, u = brute([r[:2] for r in rows])
    k = min(components, c.shape[1])
    w = c @ u[:, :k] / np.sqrt(e[:k])
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(got) == n * k and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for j in range(k):
        one = got[got.component == j + 1]
        assert np.allclose(one.explained, e[j] / e.sum(), rtol=1e-9)
        sign = 1 if abs(np.sort(one.whitened) - np.sort(w[:, j])).max() < 1e-6 else -1
        want = sorted((-1 if i is None else i, int(s), round(sign * float(v), 6) + 0.0) for i, s, v in zip(ids, deviation, w[:, j]))
        have = sorted((-1 if i != i or i is None else int(i), int(s), round(float(v), 6) + 0.0) for i, s, v in zip(one.vec_id, one.deviation, one.whitened))
        assert [h[:2] for h in have] == [h[:2] for h in want]
        assert np.allclose([h[2] for h in have], [h[2] for h in want], atol=2e-6)


def test_whole_operator(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, .5]).tolist(), "c", "x", 1) for i in range(200)]
    rows += rows[:20]                                                  # repeated rows
    rows += [(900, None, "c", "x", 1), (901, [1.0, None, 2.0, 1.0, 1.0, 1.0], None, "x", 1), (902, [float("nan")] * 6, "c", "x", 1),
             (903, [float("inf")] + [0.0] * 5, "c", "x", 1), (904, [], "c", "x", 1), (905, [1.0, 2.0], "c", "x", None),
             (None, [3.0] * 6, "c", "x", 1)]
    compared(spark, rows)
    compared(spark, rows, parts=80)                                    # partial sums are added in two stages


def test_deviation_stays_exact(spark):
    rng = np.random.default_rng(4)
    compared(spark, [(i, (rng.standard_normal(3) * 3e4).tolist(), "c", "x", 1) for i in range(100)], components=3)
    rows = [(1, [1e300, 0.0], "c", "x", 1), (2, [-1e300, 1.0], "c", "x", 1), (3, [0.0, 5.0], "c", "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, x string, n int")
    got = whitening.whitened(df).toPandas()
    assert set(got.component) >= {1} and got[got.vec_id == 1].deviation.isna().all()


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 1.0]), (2, [1.0, 1.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 7.0]), (2, [2.0, 7.0]), (3, [4.0, 7.0])], schema)).collect()
    assert [r.component for r in got] == [1, 1, 1] and abs(got[0].explained - 1) < 1e-12
