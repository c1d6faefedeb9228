"""The frames behind the registered model queries, and models by population."""

import os

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import candidates as C, factors, models as M
from cartwheel.plans import two_stage
from checks import candidates, models as Q
from checks.views import TRAIN_START, VALID_START, Views

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_model_frames_hold_all_strategies_of_the_whole_history(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    v = Views(spark, FOLDER)
    train, valid, features = Q._two_frames(v)
    # a strategy may find nothing in so small a table; those behind the eighth are in no smaller union
    assert train.unionByName(valid).filter(F.col(C.STRATEGY) >= 8).count() > 0 and "customer_total_cnt" in features
    for frame, end in ((train, TRAIN_START), (valid, VALID_START)):
        bought = {r.customer_id: r.n for r in v.transactions.filter(F.col("t_dat") < end).groupBy("customer_id").agg(F.count("*").alias("n")).collect()}
        found = frame.select("customer_id", "customer_total_cnt").distinct().collect()
        assert found and all(r.customer_total_cnt == bought.get(r.customer_id) for r in found)
    # warm and cold customers are told apart by the same whole history, and every candidate row has a score
    scored = Q.warm_cold_scores(v)
    assert scored.count() == valid.count()


def test_models_by_population(spark):
    rows = [(str(i), "a", float(i % 2), None if i % 3 == 0 else 5, i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "customer_id string, article_id string, x double, customer_total_cnt int, buy int")
    both = M.fit_warm_cold(frame, ["x"], rounds=2, min_rows=5)
    assert set(both) == {"warm", "cold"} and M.score_warm_cold(both, frame, ["x"]).count() == 120
    # without training rows of a population its rows go to the other model
    for name, part in (("warm", frame.filter("customer_total_cnt is not null")), ("cold", frame.filter("customer_total_cnt is null"))):
        one = M.fit_warm_cold(part, ["x"], rounds=2, min_rows=5)
        found = {r.customer_id: r.pred for r in M.score_warm_cold(one, frame, ["x"]).collect()}
        assert set(one) == {name} and len(found) == 120 and all((found[str(i)] > 0.5) == (i % 2 == 1) for i in range(120))
    with pytest.raises(ValueError):
        M.fit_warm_cold(frame.limit(0), ["x"])


def test_factor_candidates_runs_the_default_iterations(spark, monkeypatch):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    given = []
    real = factors.factorise
    monkeypatch.setattr(factors, "factorise", lambda pairs, ranks, iterations, seed: given.append((ranks, iterations)) or real(pairs, ranks, iterations, seed))
    assert candidates.QUERIES["factor_candidates"](spark, FOLDER).count() > 0 and given == [((2,), 10)]


def test_prepared_inputs_are_tables(spark, facts):
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-02", "2", "b")])
    people = spark.createDataFrame([("1", 1.0, None, "x", "NONE", 20.0, "p"), ("2", None, 1.0, "y", "None", 30.0, "q")],
                                   "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age double, postal_code string")
    articles = spark.createDataFrame([("a", "n"), ("b", "n")], "article_id string, product_type_name string")
    forecast = tx.select("article_id", F.col("t_dat").alias("1st_week_sales_dat"), F.lit(1.0).alias("1st_week_sales_pred"))
    tables = two_stage.prepare(tx, people, articles, forecast)
    # what is behind the facts and the forecast is computed once, however many weeks read them
    assert all(hasattr(t, "stage_folder") for t in tables)
    assert sorted(map(tuple, tables.transactions.collect())) == sorted(map(tuple, tx.collect())) and tables.forecast.count() == 2
