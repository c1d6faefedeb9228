"""Search of the strategies' limits against the grid and plain loops."""

import random

import numpy as np

from cartwheel.operators import evaluate as E, limits as Y


def frames(spark):
    rng = random.Random(3)
    tagged, truth = [], []
    for c in range(80):
        articles = [f"a{i:02d}" for i in range(40)]
        bought = rng.sample(articles, 3)
        truth += [(f"c{c}", a) for a in bought]
        for s, good in enumerate((0.8, 0.3, 0.0)):           # the last strategy finds nothing but by chance
            listed = rng.sample(bought, sum(rng.random() < good for _ in bought))
            listed += rng.sample(articles, 10)
            tagged += [(f"c{c}", a, s, r) for r, a in enumerate(dict.fromkeys(listed))]
    return (spark.createDataFrame(tagged, "customer_id string, article_id string, `1st_stage_strategy` int, `1st_stage_rank` int"),
            spark.createDataFrame(truth + truth[:5], "customer_id string, article_id string"))


def test_judged_vectors_equal_the_grid(spark):
    tagged, truth = frames(spark)
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 12, (9, 3))
    vectors[0] = 0
    found = Y.judge_limits(Y.needed_ranks(tagged, truth, [0, 1, 2]), vectors)
    grid = {r.grid_id: (r.n_pairs, r.n_hits) for r in E.limit_grid(tagged, truth, [dict(enumerate(v.tolist())) for v in vectors]).collect()}
    assert [tuple(f) for f in found.tolist()] == [grid.get(i, (0, 0)) for i in range(9)]
    assert Y.judge_limits(Y.needed_ranks(tagged.limit(0), truth, [0, 1]), vectors[:, :2]).tolist() == [[0, 0]] * 9


def test_search_keeps_to_the_budget_and_repeats_itself(spark):
    tagged, truth = frames(spark)
    found, pairs, hits, history = Y.search_limits(tagged, truth, [0, 1, 2], most=12, per_customer=5.0, rounds=4, vectors=25)
    assert pairs <= 5 * 80 and [h for _, _, h in history] == sorted(h for _, _, h in history) and history[-1][1:] == (pairs, hits)
    grid = E.limit_grid(tagged, truth, [found]).first()
    assert (grid.n_pairs, grid.n_hits) == (pairs, hits)
    # better than the same limit for all strategies within the budget, and most of it goes to the best one
    even = [r for r in E.limit_grid(tagged, truth, [{s: n for s in range(3)} for n in range(1, 5)]).collect() if r.n_pairs <= 5 * 80]
    assert hits >= max(r.n_hits for r in even) and found[0] > found[2]
    assert Y.search_limits(tagged, truth, [0, 1, 2], most=12, per_customer=5.0, rounds=4, vectors=25) == (found, pairs, hits, history)
