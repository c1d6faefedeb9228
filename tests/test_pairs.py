import collections
import random

import numpy as np
import pytest

from cartwheel.operators import pairs as B


def brute(rows, key, left_once):
    """Best partner by plain loops."""
    baskets = collections.defaultdict(collections.Counter)
    for day, customer, article in rows:
        baskets[key(day, customer)][article] += 1
    score = collections.defaultdict(collections.Counter)
    for items in baskets.values():
        for a, m in items.items():
            for b, n in items.items():
                if a != b:
                    score[a][b] += (1 if left_once else m) * n
    return sorted((a, min(c, key=lambda b: (-c[b], b)), max(c.values())) for a, c in score.items())


def test_multiplicity(facts, rows):
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-01", "1", "a"), ("2020-01-01", "1", "b"), ("2020-01-01", "1", "b"),
                ("2020-01-01", "1", "c"), ("2020-01-02", "1", "d")])
    assert rows(B.bought_same_day(tx)) == [("a", "b", 4), ("b", "a", 4), ("c", "a", 2)]
    assert rows(B.bought_by_same_customer(tx)) == [("a", "b", 2), ("b", "a", 2), ("c", "a", 2), ("d", "a", 2)]


def skewed(n, seed):
    """One customer holds a third of the rows."""
    rng = random.Random(seed)
    return [(f"2020-01-{rng.randint(1, 6):02d}", "big" if rng.random() < 0.34 else f"c{rng.randint(1, 40)}",
             f"a{int(rng.paretovariate(0.7)) % 90:02d}") for _ in range(n)]


@pytest.mark.parametrize("part_items", [1000, 6, 1])
def test_any_part_size_gives_the_same_partners(facts, rows, part_items):
    data = skewed(1500, 3)
    tx = facts(data)
    assert rows(B.bought_same_day(tx, part_items)) == brute(data, lambda d, c: (d, c), False)


def test_same_customer_with_a_big_basket(facts, rows):
    data = skewed(1200, 5)
    assert rows(B.bought_by_same_customer(facts(data), "1w", 20)) == brute(data, lambda d, c: c, True)


@pytest.mark.parametrize("part_items", [500, 7])
def test_passes_and_dealt_hot_items_give_the_same_partners(spark, facts, rows, monkeypatch, part_items):
    """Left items in many passes and tasks; some have more pairs than a task may hold, so their right items are dealt out."""
    monkeypatch.setattr(B, "TASK_PAIRS", 40)
    monkeypatch.setattr(B, "PASS_PAIRS", 300)
    monkeypatch.setattr(B, "PASS_ROWS", 0)
    plans = []
    real = B._plan
    monkeypatch.setattr(B, "_plan", lambda *a: plans.append(real(*a)) or plans[-1])
    data = skewed(500, 9)
    assert rows(B.bought_by_same_customer(facts(data), "all", part_items)) == brute(data, lambda d, c: c, True)
    (_, deal, passes), = plans
    assert deal.max() > 3 and len(passes) > 5
    assert rows(B.bought_same_day(facts([("2020-01-01", "1", "a"), ("2020-01-02", "1", "b")]))) == []


def test_pairs_are_summed_in_slices(monkeypatch):
    """The pairs of one task, made a few at a time, against plain loops."""
    rng = np.random.default_rng(4)
    n, m = rng.integers(1, 4, 60), rng.integers(1, 9, 60)
    left, right = rng.integers(0, 12, n.sum()), rng.integers(0, 15, m.sum())
    lw, rw = rng.integers(1, 4, len(left)).astype(float), rng.integers(1, 4, len(right)).astype(float)
    score = collections.defaultdict(collections.Counter)
    for i in range(60):
        for x in range(n[:i].sum(), n[:i + 1].sum()):
            for y in range(m[:i].sum(), m[:i + 1].sum()):
                if left[x] != right[y]:
                    score[int(left[x])][int(right[y])] += lw[x] * rw[y]
    want = sorted((a, max(c.values()), min(c, key=lambda b: (-c[b], b))) for a, c in score.items())
    for most in (1, 10, 10_000):
        monkeypatch.setattr(B, "TASK_PAIRS", most)
        found = B._best_pairs(n, m, left, lw, right, rw)
        assert list(zip(*(found[c].to_pylist() for c in ("a", "score", "b")))) == want
