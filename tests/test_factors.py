"""Non-negative factors and the best products against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.operators import factors as X


def nnls(sums, gram):
    """By trying every set of positive coordinates."""
    k = len(gram)
    best, value = np.zeros(k), 0.0
    for mask in range(1, 2 ** k):
        on = [i for i in range(k) if mask >> i & 1]
        try:
            w = np.linalg.solve(gram[np.ix_(on, on)], sums[on])
        except np.linalg.LinAlgError:
            continue
        if (w >= 0).all() and (v := 0.5 * w @ gram[np.ix_(on, on)] @ w - sums[on] @ w) < value:
            value, best = v, np.zeros(k)
            best[on] = w
    return best


def test_rows_solve_their_least_squares_problem():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4):
        h = rng.random((50, k)) * rng.random(k)
        sums = rng.normal(1, 3, (40, k))
        found = X.solve_rows(sums, h.T @ h)
        for row, s in zip(found, sums):
            assert np.abs(row - nnls(s, h.T @ h)).max() < 1e-8
    assert X.solve_rows(np.zeros((0, 2)), np.eye(2)).shape == (0, 2)


def test_factors_equal_numpy_and_the_error_falls(spark):
    rng = np.random.default_rng(2)
    taste = rng.random((60, 3)) ** 4 @ rng.random((3, 25)) ** 4
    cells = [(u, i) for u in range(60) for i in range(25) if rng.random() < min(0.9, 3 * taste[u, i])]
    pairs = spark.createDataFrame([(f"c{u}", f"a{i:02d}") for u, i in cells] + [("c1", None)] + [(f"c{cells[0][0]}", f"a{cells[0][1]:02d}")],
                                  "customer_id string, article_id string")
    ranks = (2, 3, 5)
    rows, items, history = X.factorise(pairs, ranks, iterations=6, tolerance=0.0)
    v = np.zeros((60, 25))
    v[tuple(zip(*cells))] = 1
    users, articles = sorted({u for u, _ in cells}), sorted({i for _, i in cells})
    v = v[np.ix_(users, articles)]
    start = {r.article_id: np.array(r.f) for r in X.first_factors(
        spark.createDataFrame([(f"a{i:02d}",) for i in articles], "article_id string"), "article_id", ranks, v.sum() / v.size, 42).collect()}
    h = np.array([start[f"a{i:02d}"] for i in articles])
    found = [{r[0]: np.array(r.f) for r in side.collect()} for side in (rows, items)]
    assert len(found[0]) == len(users) and len(found[1]) == len(articles)
    for rank, part in zip(ranks, X._parts(ranks)):
        own, errors = h[:, part], []
        for iteration in range(6):
            w = X.solve_rows(v @ own, own.T @ own)
            errors.append(np.sum((v - w @ own.T) ** 2))
            if iteration < 5:
                own = X.solve_rows(v.T @ w, w.T @ w)
        told = [e for r, _, e in history if r == rank]
        assert np.abs(np.array(told) - errors).max() < 1e-6 and all(b <= a + 1e-9 for a, b in zip(told, told[1:])) and told[-1] < told[0]
        assert max(np.abs(found[0][f"c{u}"][part] - x).max() for u, x in zip(users, w)) < 1e-6
        assert max(np.abs(found[1][f"a{i:02d}"][part] - x).max() for i, x in zip(articles, own)) < 1e-6
    assert [r for r, i, _ in history if i == 0] == list(ranks)
    none = X.factorise(pairs.limit(0))
    assert none[0].collect() == [] and none[2] == []


@pytest.mark.parametrize("n", [1, 12])
def test_best_products_equal_all_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(X, "FIRST_GROUP", 16)
    monkeypatch.setattr(X, "LARGEST_GROUP", 64)
    rng = np.random.default_rng(3)
    w = rng.random((80, 3)) * (rng.random((80, 3)) < 0.7)
    h = np.round(rng.random((500, 3)) * rng.pareto(1.5, (500, 1)) * (rng.random((500, 3)) < 0.6), 2)      # ties, zeros, long tails
    rows = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(w)], "customer_id string, f array<double>")
    items = spark.createDataFrame([(f"a{i:03d}", x.tolist()) for i, x in enumerate(h)], "article_id string, f array<double>")
    best, share = X.best_products(rows, items, n)
    found = {}
    for r in sorted(best.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.customer_id, []).append((r.article_id, r.affinity))
    for i, x in enumerate(w):
        scores = h @ x
        want = sorted(range(500), key=lambda a: (-scores[a], a))[:n]
        got = found[f"c{i}"]
        assert [round(s, 9) for _, s in got] == [round(float(scores[a]), 9) for a in want]
        if (np.diff(np.sort(-scores)[:n + 1]) > 1e-9).all():
            assert [a for a, _ in got] == [f"a{a:03d}" for a in want]
    assert 0 < share < 0.6
    few, all_ = X.best_products(rows, items.limit(5), n)
    assert few.count() == 80 * min(n, 5) and all_ == 1.0
    assert X.best_products(rows.limit(0), items, n)[0].count() == 0


def test_candidates_are_for_targets_with_purchases(spark):
    history = spark.createDataFrame([(f"c{u}", f"a{i}") for u in range(8) for i in range(6) if (u + i) % 2 == 0], "customer_id string, article_id string")
    targets = spark.createDataFrame([("c0",), ("c0",), ("c3",), ("never",)], "customer_id string")
    found = X.factor_candidates(history, targets, n=3)
    rows = found.groupBy("customer_id").agg(F.collect_set("article_id").alias("a"), F.count("*").alias("n")).collect()
    assert {r.customer_id: (set(r.a), r.n) for r in rows} == {"c0": ({"a0", "a2", "a4"}, 3), "c3": ({"a1", "a3", "a5"}, 3)}
