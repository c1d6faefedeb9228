import numpy as np
import pandas as pd
import pytest

from cartwheel.operators import ensemble as B, evaluate as E


def ranked(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, article_id string, rank int")


def truth(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, article_id string")


def test_map_by_hand(spark):
    predicted = ranked(spark, [("1", "a", 1), ("1", "x", 2), ("1", "b", 3)] + [("2", "t0", 1)])
    actual = truth(spark, [("1", "a"), ("1", "b"), ("1", "b")] + [("2", f"t{i}") for i in range(20)] + [("3", "z")])
    ap = {r.customer_id: r.ap for r in E.average_precision(predicted, actual).collect()}
    assert ap["1"] == pytest.approx((1 + 2 / 3) / 2)
    assert ap["2"] == pytest.approx(1 / 12)          # denominator is capped at 12
    assert ap["3"] == 0.0                            # no prediction
    row = E.mean_average_precision(predicted, actual).first()
    assert row.n_customers == 3 and row.map == pytest.approx(sum(ap.values()) / 3)


def test_best_score_kept_once(spark, rows):
    scored = spark.createDataFrame([("1", "a", 0.1), ("1", "a", 0.9), ("1", "b", 0.9), ("1", "c", 0.2)], "customer_id string, article_id string, pred double")
    assert rows(E.best_by_score(scored, n=2), "article_id", "rank") == [("a", 1), ("b", 2)]
    assert rows(E.best_by_score(scored, n=3, distinct=False), "article_id", "rank") == [("a", 1), ("b", 2), ("c", 3)]


def test_submission_lists_in_rank_order(spark, rows):
    sample = spark.createDataFrame([("1",), ("2",)], "customer_id string")
    out = E.submission(sample, ranked(spark, [("1", "02", 2), ("1", "10", 1)]), n=2)
    assert rows(out) == [("1", "10 02", 2, True), ("2", None, 0, False)]


def test_coverage_counts_pairs_once(spark):
    predicted = truth(spark, [("1", "a"), ("1", "a"), ("2", "q")])
    row = E.coverage(predicted, truth(spark, [("1", "a"), ("1", "b")])).first()
    assert (row.n_true, row.n_hits, row.coverage) == (2, 1, 0.5)


def test_strategy_report_accumulates(spark, rows):
    tagged = spark.createDataFrame([("1", "a", 0, 0), ("1", "b", 1, 0), ("1", "a", 1, 1), ("1", "q", 2, 0)],
                                   "customer_id string, article_id string, `1st_stage_strategy` int, `1st_stage_rank` int")
    report = E.strategy_report(tagged, truth(spark, [("1", "a"), ("1", "b")]))
    assert rows(report) == [(0, 0.5, 0.5), (1, 1.0, 1.0), (2, 0.0, 1.0)]


def test_average_ranks_and_correlations_match_pandas(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.integers(-5, 6, 300), [3] * 200, [10 ** 6]]).astype(float)
    p = y * 0.1 + rng.normal(size=len(y)).round(1)
    pdf = pd.DataFrame({"y": y, "p": p})
    frame = spark.createDataFrame(pdf)
    ranks = {r.value: r.avg_rank for r in E.average_ranks(frame, "y").collect()}
    expected = pdf.y.rank()
    assert all(ranks[v] == pytest.approx(e) for v, e in zip(pdf.y, expected))
    row = E.regression_report(frame, "y", "p").first()
    assert row.rmse == pytest.approx(float(np.sqrt(((y - p) ** 2).mean())))
    assert row.mae == pytest.approx(float(np.abs(y - p).mean()))
    assert row.pearson == pytest.approx(pdf.y.corr(pdf.p), abs=1e-9)
    assert row.spearman == pytest.approx(expected.corr(pdf.p.rank()), abs=1e-9)


def test_short_lists_rank_from_their_length(spark, rows):
    oof = spark.createDataFrame([("1", "a", 0.9, "e"), ("1", "b", 0.5, "e"), ("2", "c", 0.1, "e")], "customer_id string, article_id string, pred double, exp string")
    assert rows(B.oof_ranks(oof), "article_id", "rank") == [("a", 2), ("b", 1), ("c", 1)]


def test_blend_rules(spark, rows):
    ranks = spark.createDataFrame([("1", "a", "e", 12), ("1", "a", "f", 1), ("1", "b", "f", 12), ("1", "c", "g", 12)],
                                  "customer_id string, article_id string, exp string, rank int")
    weights = {"e": 0.5, "f": 0.6}
    assert rows(B.blend(ranks, weights, "max"), "article_id", "score") == [("a", 6.0), ("b", pytest.approx(7.2)), ("c", 0.0)]
    assert rows(B.blend(ranks, weights, "sum"), "article_id", "rank") == [("a", 2), ("b", 1), ("c", 3)]
    assert B.last_weight({"e": 0.5, "f": 0.3}, ["e", "f", "g"])["g"] == pytest.approx(0.2)


def test_weight_grid_picks_the_better_experiment(spark):
    ranks = spark.createDataFrame([("1", "hit", "e", 1), ("1", "miss", "f", 1)], "customer_id string, article_id string, exp string, rank int")
    report = B.evaluate_weights(ranks, truth(spark, [("1", "hit")]), [{"e": 0.0, "f": 1.0}, {"e": 1.0, "f": 0.0}])
    best = B.best_weights(report).first()
    assert best.vector_id == 1 and best.map == 1.0


def test_simplex_search_is_repeatable_and_near_the_grid(spark):
    import random

    from cartwheel.operators import ensemble as X

    rng = random.Random(5)
    truth, ranks = [], []
    for c in range(60):
        bought = {f"a{i}" for i in rng.sample(range(30), 3)}
        truth += [(f"c{c}", a) for a in sorted(bought)]
        for exp, good in (("x", 0.75), ("y", 0.45), ("z", 0.05)):          # experiments of falling worth
            listed = rng.sample(sorted(bought), 3 if rng.random() < good else 1)
            listed += [a for a in rng.sample([f"a{i}" for i in range(30)], 12) if a not in listed]
            ranks += [(f"c{c}", a, exp, 12 - i) for i, a in enumerate(listed[:12])]
    ranks = spark.createDataFrame(ranks, "customer_id string, article_id string, exp string, rank int")
    truth = spark.createDataFrame(truth, "customer_id string, article_id string")
    grid = [{"x": a / 4, "y": b / 4, "z": 1 - a / 4 - b / 4} for a in range(5) for b in range(5 - a)]
    best = X.best_weights(X.evaluate_weights(ranks, truth, grid, "sum")).first()["map"]
    found, value, tried = X.search_weights(ranks, truth, ["x", "y", "z"], "sum", rounds=6)
    assert abs(sum(found.values()) - 1) < 1e-6 and min(found.values()) >= 0
    assert value >= best - 0.01 and tried < 80 and found["x"] > found["z"]
    # the value is that of the weights, and the search repeats itself
    assert abs(X.evaluate_weights(ranks, truth, [found], "sum").first()["map"] - value) < 1e-9
    assert X.search_weights(ranks, truth, ["x", "y", "z"], "sum", rounds=6) == (found, value, tried)
    assert X.search_weights(ranks, truth, ["x"], "sum")[0] == {"x": 1.0}


def test_dimensions_without_wanted_columns_are_not_joined(spark, facts, rows):
    from cartwheel.operators import prepare as P

    sold = facts([("2020-01-01", "c1", "a1"), ("2020-01-02", "c2", "a9")])
    customers = spark.createDataFrame([("c1", 30.0)], "customer_id string, age double")
    articles = spark.createDataFrame([("a1", "red")], "article_id string, colour string")
    wide = P.denormalise(sold, customers, articles, ["age"], [])
    assert rows(wide, "customer_id", "article_id", "age") == [("c1", "a1", 30.0), ("c2", "a9", None)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert rows(P.denormalise(sold, customers, articles), "article_id", "colour") == [("a1", "red"), ("a9", None)]
