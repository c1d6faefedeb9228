"""Ranking gradients against plain loops over all pairs."""

import math
import random

import numpy as np
import pytest

from cartwheel.operators import gradients as G


def ap(labels, cutoff):
    hits = total = 0
    for i, y in enumerate(labels[:cutoff]):
        if y:
            hits += 1
            total += hits / (i + 1)
    return total / min(max(sum(labels), 1), cutoff)


def ndcg(labels, cutoff):
    dcg = lambda ys: sum(y / math.log2(i + 2) for i, y in enumerate(ys[:cutoff]))
    return dcg(labels) / dcg(sorted(labels, reverse=True))


def by_hand(score, label, cutoff, metric):
    """Every pair of unlike labels, weighted by the metric before and after the swap."""
    order = sorted(range(len(score)), key=lambda i: -score[i])
    gradient, hessian = [0.0] * len(score), [0.0] * len(score)
    if not 0 < sum(label) < len(label):
        return gradient, hessian
    ranked = [label[i] for i in order]
    measure = ndcg if metric == "ndcg" else ap
    for a, i in enumerate(order):
        for b, j in enumerate(order):
            if label[i] and not label[j]:
                swapped = list(ranked)
                swapped[a], swapped[b] = swapped[b], swapped[a]
                weight = abs(measure(ranked, cutoff) - measure(swapped, cutoff))
                doubt = 1 / (1 + math.exp(score[i] - score[j]))
                gradient[i] -= weight * doubt
                gradient[j] += weight * doubt
                hessian[i] += weight * doubt * (1 - doubt)
                hessian[j] += weight * doubt * (1 - doubt)
    return gradient, hessian


@pytest.mark.parametrize("metric", ["ndcg", "map"])
@pytest.mark.parametrize("cutoff", [1, 3, 12])
def test_gradients_equal_swaps_of_all_pairs(metric, cutoff):
    rng = random.Random(cutoff)
    sizes = [1, 2, 5, 30, 14, 3, 8, 1]
    score = [rng.choice([0.0, 0.5, rng.gauss(0, 2)]) for _ in range(sum(sizes))]
    label = [int(rng.random() < 0.3) for _ in score]
    label[8:38] = [0] * 30                                   # a group without a purchase
    got = G.ranking_gradients(np.array(score), np.array(label), np.array(sizes), cutoff, metric)
    at, want = 0, [[], []]
    for n in sizes:
        for part, values in zip(want, by_hand(score[at:at + n], label[at:at + n], cutoff, metric)):
            part += values
        at += n
    assert np.abs(got[0] - want[0]).max() < 1e-12 and np.abs(got[1] - want[1]).max() < 1e-12
    found = G.average_precisions(np.array(score), np.array(label), np.array(sizes), np.array([2] * len(sizes)), cutoff)
    at = 0
    for n, value in zip(sizes, found):
        ranked = [label[i] for i in sorted(range(at, at + n), key=lambda i: -score[i])]
        assert abs(value - ap(ranked, cutoff) * min(max(sum(ranked), 1), cutoff) / min(2, cutoff)) < 1e-12
        at += n


def test_column_form_equals_the_arrays(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH_ROWS", 7)                  # groups go over the ends of batches
    rng = random.Random(4)
    rows = [(None if g == 3 else f"c{g}", f"a{i:02d}", rng.choice([1, 2, 3]), int(rng.random() < 0.3)) for g in range(40) for i in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(rows, "customer_id string, article_id string, score int, buy int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = {(r.customer_id, r.article_id): (r.gradient, r.hessian) for r in G.add_ranking_gradients(frame, "score").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for g in range(40):
        mine = [r for r in rows if r[0] == (None if g == 3 else f"c{g}")]
        gradient, hessian = by_hand([r[2] for r in mine], [r[3] for r in mine], 12, "ndcg")
        for r, a, b in zip(mine, gradient, hessian):
            assert abs(found[r[:2]][0] - a) < 1e-12 and abs(found[r[:2]][1] - b) < 1e-12
    assert G.add_ranking_gradients(frame.limit(0), "score").collect() == []
