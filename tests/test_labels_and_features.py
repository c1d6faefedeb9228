import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import features as X, labels as L


def pairs(spark, *items):
    return spark.createDataFrame(list(items), "customer_id string, article_id string")


def test_labels(facts, spark, rows):
    target = facts([("2020-01-01", "1", "a"), ("2020-01-02", "1", "a")])
    assert rows(L.add_labels(pairs(spark, ("1", "a"), ("1", "b"), ("1", "a")), target)) == [("1", "a", 1), ("1", "a", 1), ("1", "b", 0)]


@pytest.mark.parametrize("ratio,expected", [(1.0, 10), (2.5, 25), (50.0, 190)])
def test_undersample_draws_exactly_n(spark, ratio, expected):
    frame = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") < 10).cast("int").alias("buy"))
    drawn = L.undersample(frame, ["k"], ratio, seed=7)
    assert drawn.filter("buy = 1").count() == 10
    assert drawn.filter("buy = 0").count() == expected
    assert drawn.exceptAll(L.undersample(frame, ["k"], ratio, seed=7)).isEmpty()


def test_bags_differ(spark):
    frame = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") < 10).cast("int").alias("buy"))
    bags = L.bagged_undersample(frame, ["k"], 1.0, [0, 1, 2]).filter("buy = 0")
    sets = [frozenset(r.k for r in bags.filter(F.col("seed") == s).collect()) for s in range(3)]
    assert all(len(s) == 10 for s in sets) and len(set(sets)) == 3


def test_truth_lists_have_one_row_per_customer(spark):
    target = spark.range(50).select(F.lit("1").alias("customer_id"), F.col("id").cast("string").alias("article_id"))
    found = L.truth_lists(target.union(target)).collect()
    assert len(found) == 1 and found[0].article_ids == sorted(str(i) for i in range(50))


@pytest.fixture(scope="module")
def history(facts, spark):
    people = spark.createDataFrame([("1", 20.0), ("2", 40.0), ("3", None), ("4", 21.0)], "customer_id string, age double")
    kinds = spark.createDataFrame([("a", "Sport"), ("b", "Divided"), ("c", None)], "article_id string, index_group_name string")
    tx = facts([("2020-03-31", "1", "a", 2.0, 1), ("2020-03-29", "2", "a", 4.0, 2), ("2020-03-27", "4", "a", 3.0, 2),
                ("2020-03-23", "1", "b", 5.0, 1), ("2020-03-20", "1", "b", 6.0, 1), ("2020-01-01", "3", "c", 1.0, 2)])
    return tx.join(people, "customer_id").join(kinds, "article_id", "left")


def only(frame, key, value):
    return frame.filter(F.col(key) == value).first().asDict()


def test_article_lifetime(history):
    a = only(X.article_lifetime(history), "article_id", "a")
    assert (a["article_total_cnt"], a["article_total_latest_buy"], a["article_total_1st_buy"]) == (3, 0, 4)
    assert a["article_age_std"] == pytest.approx(statistics.stdev([20, 40, 21]))
    c = only(X.article_lifetime(history), "article_id", "c")
    assert c["article_total_cnt"] == 1 and c["article_age_std"] is None and c["article_age_max"] is None


def test_article_weeks_use_their_own_last_day(history):
    weekly = X.article_weekly(history, 2)
    a, b = only(weekly, "article_id", "a"), only(weekly, "article_id", "b")
    assert a["article_age_median_1weekago"] == 21 and a["article_total_cnt_2weekago"] is None
    # week 1 runs 18 to 24 March; its last sale is on the 23rd
    assert (b["article_total_latest_buy_2weekago"], b["article_total_1st_buy_2weekago"]) == (0, 3)
    both = only(X.article_statistics(history, 2), "article_id", "b")
    assert both["article_total_latest_buy"] == 8 and both["article_total_latest_buy_2weekago"] == 0


def test_channels(history):
    a = only(X.article_by_channel(history), "article_id", "a")
    assert (a["online_article_total_cnt"], a["shop_article_total_cnt"], a["online_article_price_max"]) == (2, 1, 4.0)


def test_customer_shares(history):
    one = only(X.customer_lifetime(history, channels=True), "customer_id", "1")
    assert one["Sport"] == pytest.approx(1 / 3) and one["Divided"] == pytest.approx(2 / 3) and one["Menswear"] == 0
    assert one["shop"] == 1.0
    weekly = only(X.customer_weekly(history), "customer_id", "1")
    assert weekly["Sport_1weekago"] == 1.0 and weekly["Divided_2weekago"] == 1.0 and weekly["customer_total_cnt_2weekago"] == 2


def test_repeated_candidates_do_not_multiply_counts(history, spark, rows):
    wanted = pairs(spark, ("1", "b"), ("1", "b"), ("2", "b"))
    assert rows(X.pair_history(wanted, history)) == [("1", "b", 2, 11, 8)]
    assert rows(X.pair_trailing_counts(wanted, history)) == [("1", "b", 2, 2, 2)]


def test_rates_ignore_null_values_and_miss_as_null(history, spark, rows):
    frame = spark.createDataFrame([("1", "a", "Sport"), ("2", "b", "Divided"), ("3", "c", None)], "customer_id string, article_id string, index_group_name string")
    found = X.add_same_article_type_rates(frame, history, ["index_group_name"])
    assert rows(found, "customer_id", "index_group_name_customer_buy_rate") == [("1", pytest.approx(1 / 3)), ("2", None), ("3", None)]


def test_repeat_rate(facts, rows):
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-01", "1", "a"), ("2020-01-02", "1", "a"), ("2020-01-02", "1", "b")])
    assert rows(X.repeat_rate(tx, "customer_id")) == [("1", pytest.approx(1 / 3))]
    assert rows(X.repeat_rate(tx, "article_id")) == [("a", 0.5), ("b", 0.0)]


def test_first_week(facts, rows):
    tx = facts([("2020-01-02", "1", "a"), ("2020-01-09", "1", "a"), ("2020-01-10", "1", "a"), ("2020-01-01", "1", "old")])
    assert rows(X.first_week_sales(tx, "2020-01-01")) == [("a", dt.date(2020, 1, 2), 2)]
    offsets = X.first_sale(tx).filter("article_id = 'a'")
    assert rows(offsets, "1st_tran_dat_diff") == [(0,), (7,), (8,)]


def test_assembled_rows_are_the_candidates(history, facts, spark):
    tx = history.select("t_dat", "customer_id", "article_id", "price", "sales_channel_id")
    articles = history.select("article_id", "index_group_name").distinct()
    people = history.select("customer_id", "age").distinct()
    forecast = spark.createDataFrame([("b", dt.date(2020, 3, 20), 3.0)], "article_id string, `1st_week_sales_dat` date, `1st_week_sales_pred` double")
    wanted = pairs(spark, ("1", "a"), ("1", "b"), ("9", "a"))
    frame = X.add_features(wanted, tx, articles, people, forecast)
    got = {(r.customer_id, r.article_id): r for r in frame.collect()}
    assert len(got) == 3
    assert got[("1", "b")]["count"] == 2 and got[("1", "b")]["new_article"] == 1
    assert got[("9", "a")]["customer_total_cnt"] is None and got[("9", "a")]["article_total_cnt"] == 3
    assert got[("1", "a")]["index_group_name_customer_buy_rate"] == pytest.approx(1 / 3)


def test_optional_blocks_equal_the_single_features(history, facts, spark, rows):
    tx = history.select("t_dat", "customer_id", "article_id", "price", "sales_channel_id")
    articles = history.select("article_id", "index_group_name").distinct()
    people = history.select("customer_id", "age").distinct().withColumn("FN", F.when(F.col("customer_id") == "1", 1.0))
    forecast = spark.createDataFrame([], "article_id string, `1st_week_sales_dat` date, `1st_week_sales_pred` double")
    wanted = pairs(spark, ("1", "a"), ("1", "b"), ("2", "a"), ("9", "a"))
    plain = X.add_features(wanted, tx, articles, people, forecast)
    full = X.add_features(wanted, tx, articles, people, forecast, extras=X.EXTRAS)
    assert rows(full, *plain.columns) == rows(plain)
    aged = tx.join(people.select("customer_id", "age"), "customer_id", "left")
    singles = wanted
    for part, key in ((X.article_by_channel(aged), "article_id"), (X.repeat_rate(tx, "article_id"), "article_id"), (X.repeat_rate(tx, "customer_id"), "customer_id"),
                      (X.customer_lifetime(history, X.INDEX_GROUPS, True).select("customer_id", "shop", "online"), "customer_id"),
                      (X.pair_trailing_counts(wanted, tx), ["customer_id", "article_id"])):
        singles = singles.join(part, key, "left")
    singles = X.add_same_customer_type_rates(singles.join(people, "customer_id", "left"), tx.join(people, "customer_id", "left"), ["FN"])
    ages = X.candidate_age_of_articles(plain).select("customer_id", "article_id", "customer_article_total_1st_buy_mean", "customer_article_total_1st_buy_median")
    singles = singles.drop("age", "FN").join(ages, ["customer_id", "article_id"])
    assert set(full.columns) == set(plain.columns) | set(singles.columns)
    assert rows(full, *singles.columns) == rows(singles)
    with pytest.raises(ValueError):
        X.add_features(wanted, tx, articles, people, forecast, extras=["other"])


def test_attribute_rates_take_one_shuffle_behind_the_counts(spark):
    history = spark.createDataFrame([("1", "red", 3), ("1", "red", None), ("1", "blue", 3), ("2", None, 4), (None, "red", 3)], "customer_id string, colour string, size int")
    rates = X.same_article_type_rates(history, ["colour", "size"])
    assert rates._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, rates.collect())) == [("1", "colour", "blue", 1 / 3), ("1", "colour", "red", 2 / 3), ("1", "size", "3", 1.0), ("2", "size", "4", 1.0)]
    # rows that are counts already
    weighed = history.withColumn("w", F.lit(2))
    assert sorted(map(tuple, X._rate_long(weighed, "customer_id", ["colour", "size"], "w").collect())) == sorted(map(tuple, rates.collect()))


def test_candidates_get_rates_counted_for_their_customers_alone(spark, monkeypatch):
    history = spark.createDataFrame([("1", "a", "red"), ("1", "b", "blue"), ("2", "a", "red"), ("2", "b", "blue")], "customer_id string, article_id string, colour string")
    frame = spark.createDataFrame([("1", "a", "red"), ("1", "a", "red"), ("1", "c", None), ("3", "a", "red"), (None, "a", "red")], "customer_id string, article_id string, colour string")
    seen, real = [], X._rate_maps
    monkeypatch.setattr(X, "_rate_maps", lambda rows, *a: seen.append({r.customer_id for r in rows.collect()}) or real(rows, *a))
    found = X.add_same_article_type_rates(frame, history, ["colour"])
    assert sorted(map(tuple, found.select("customer_id", "article_id", "colour_customer_buy_rate").collect()), key=repr) == sorted(
        [("1", "a", 0.5), ("1", "a", 0.5), ("1", "c", None), ("3", "a", None), (None, "a", None)], key=repr)
    assert seen == [{"1"}]
