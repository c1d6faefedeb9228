"""Spectral divide and conquer and whitening against NumPy and exact arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from cartwheel.llm import whitening as W


def spectra():
    rng = np.random.default_rng(5)
    yield np.array([[3.0]])
    yield np.zeros((4, 4))
    yield np.eye(5) * 2.5
    yield np.diag([4.0, 4.0, 4.0, 1.0, 1.0, 2.5])
    yield np.diag([1e6, 1.0, 1e-6])
    for n, values in ((2, [5, 1]), (17, 2.0 ** -np.arange(17)), (40, np.append(np.ones(20), np.arange(20) + 2)), (64, rng.uniform(0.5, 900, 64)),
                      (33, np.append(np.zeros(30), [1, 2, 3])), (12, 1 + 1e-9 * np.arange(12))):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = (q * np.array(values, float)) @ q.T
        yield (a + a.T) / 2


@pytest.mark.parametrize("a", list(spectra()), ids=lambda a: str(len(a)))
def test_components_are_eigenvectors(a):
    values, axes = W.components(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-13 * scale * len(a)
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-13
    assert np.linalg.norm(a @ axes - axes * values) < 2e-13 * scale * len(a)


def test_polar_factor_is_the_sign():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))
    signs = np.where(np.arange(30) % 3, 1.0, -1.0)
    size = 10.0 ** np.linspace(-9, 3, 30)
    sign = W.polar_factor((q * (signs * size)) @ q.T)
    assert np.abs(sign @ sign - np.eye(30)).max() < 1e-13 and round(np.trace(sign)) == signs.sum()


def vectors(rng, n=300, d=20):
    base = rng.standard_normal((n, d)) * np.linspace(0.2, 3, d) + rng.uniform(-5, 5, d)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(40)] + [(None, base[3].tolist()), (5, base[4].tolist())]
    broken = [base[0].tolist() for _ in range(5)]
    broken[0][3], broken[1][0], broken[2][19], broken[3][1] = None, float("nan"), float("inf"), 1e300
    return rows, [*[(2000 + i, b) for i, b in enumerate(broken[:4])], (2010, None), (2011, []), (2012, [1.0] * 19)]


def test_whitening_equals_numpy(spark):
    rows, broken = vectors(np.random.default_rng(2))
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + broken], "vec_id int, embedding array<double>, x string, n int").repartition(3)
    found = W.whiten(frame).collect()
    whole = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == 16 * len(rows) and {r.n for r in found} == {n} and n < len(rows)
    assert {r.component for r in found} == set(range(1, 17)) and len({r.identity_error for r in found}) == 1
    assert 0 <= found[0].identity_error < 1e-10
    want = {}
    for (i, _), x in zip(rows, whole):
        want.setdefault(i, []).append((sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)), (x - sums / n) @ axes[:, :16] / np.sqrt(values[:16])))
    signs = {}
    for r in sorted(found, key=lambda r: -abs(r.whitened)):
        deviations, projections = zip(*want[r.vec_id])
        assert r.deviation in deviations
        k = r.component - 1
        assert abs(r.explained / (values[k] / np.trace(cov)) - 1) < 1e-9
        sign = signs.setdefault(k, np.sign(r.whitened) * np.sign(projections[deviations.index(r.deviation)][k]))
        assert min(abs(r.whitened - sign * p[k]) for p in projections) < 1e-7


def test_few_rows_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect() == []      # one vector
    two = W.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [1.5, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [
        (1, 1, 2, 64 ** 2, 1.0, 1.0), (2, 1, 2, 64 ** 2, 1.0, 1.0), (3, 1, 2, 64 ** 2, 1.0, 1.0)]


def test_sums_and_deviations_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-2 ** 52, 2 ** 52, (3000, 3))
    assert W._exact_sums(x).tolist() == [sum(map(int, c)) for c in x.T]
    n, sums = 3000, W._exact_sums(x)
    whole = [(2 * int(s) + n) // (2 * n) for s in sums]
    center = W.Center(n, np.array(whole), np.array([int(s) - n * w for s, w in zip(sums, whole)]))
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert center.deviations(x) == [v if v < 2 ** 63 else None for v in exact]
    small = W.Center(n, np.array([5, 5, 5]), np.array([1, -2, 3]))
    near = rng.integers(-50, 60, (100, 3))
    assert small.deviations(near) == [sum((n * (int(a) - 5) - r) ** 2 for a, r in zip(row, (1, -2, 3))) for row in near]
    moved = center.moved(x[:5])
    for row, got in zip(x[:5], moved):
        assert all(abs(g - float(Fraction(int(a)) - Fraction(int(s), n))) <= 1e-15 * 2 ** 53 for a, s, g in zip(row, sums, got))
