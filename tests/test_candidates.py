import pytest
from pyspark.sql import functions as F

from cartwheel.operators import candidates as C


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "customer_id string")


def test_equal_counts_take_the_smaller_article(facts, rows):
    tx = facts([("2020-01-02", "c", "02"), ("2020-01-01", "c", "01"), ("2020-01-03", "c", "03"), ("2020-01-03", "c", "03"),
                ("2020-01-03", None, "09")])
    found = C.customer_frequent(tx, 2)
    assert rows(found, "article_id", "cnt", "1st_stage_rank") == [("01", 1, 1), ("03", 2, 0)]
    recent = C.customer_frequent(tx, 2, recency_ties=True)
    assert rows(recent, "article_id", "1st_stage_rank") == [("02", 1), ("03", 0)]


def test_leading_zeros_survive(facts, rows):
    tx = facts([("2020-01-02", "c", "0108775015"), ("2020-01-02", "d", "0108775015")])
    assert rows(C.popular_article(tx)) == [("0108775015", 2, 0)]


def test_segment_list_goes_to_active_customers_only(facts, rows, spark):
    types = spark.createDataFrame([("1", 0), ("2", 0), ("3", 0)], "customer_id string, customer_type int")
    tx = facts([("2020-03-31", "1", "a"), ("2020-03-31", "2", "b"), ("2020-01-01", "3", "c")]).join(types, "customer_id")
    found = C.segment_frequent(tx, 12, "1w")
    assert rows(found, "customer_id", "article_id") == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]


def test_favourite_value_ties_and_nulls(facts, rows, spark):
    kinds = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", None)], "article_id string, kind string")
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-01", "1", "b"), ("2020-01-01", "1", "c"), ("2020-01-01", "2", "c")]).join(kinds, "article_id")
    assert rows(C.favourite_value(tx, "kind")) == [("1", "w")]
    assert rows(C.favourite_attribute_frequent(tx, "kind"), "customer_id", "article_id") == [("1", "b")]


def test_null_group_ranks_last(facts, rows, spark):
    ages = spark.createDataFrame([("1", 20), ("2", 20), ("3", None)], "customer_id string, age int")
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-01", "1", "b"), ("2020-01-01", "2", "b"), ("2020-01-01", "3", "a")]).join(ages, "customer_id")
    assert rows(C.group_count_frequent(tx, "age")) == [("1", "a", 1, 1), ("1", "b", 2, 0), ("2", "b", 2, 0), ("3", "a", None, 0)]


def test_fill_keeps_own_first_and_repeats_nothing(facts, rows, spark):
    tx = facts([("2020-01-01", "1", "z"), ("2020-01-01", "1", "a"), ("2020-01-01", "1", "z"), ("2020-01-01", "2", "a"),
                ("2020-01-01", "2", "b"), ("2020-01-01", "2", "c")])
    filled = C.fill_to(C.customer_frequent(tx, 12), C.popular_article(tx, 3), ids(spark, "1", "new"), 3)
    assert rows(filled) == [("1", "a", 2), ("1", "b", 3), ("1", "z", 1), ("new", "a", 1), ("new", "b", 3), ("new", "z", 2)]


def test_wide_union_has_one_row_per_pair(spark, rows):
    tagged = spark.createDataFrame([("1", "a", 0, 3), ("1", "a", 1, 0), ("1", "b", 1, 1)],
                                   "customer_id string, article_id string, `1st_stage_strategy` int, `1st_stage_rank` int")
    assert rows(C.wide_union(tagged, [0, 1])) == [("1", "a", 3, 0), ("1", "b", None, 1)]


@pytest.mark.parametrize("distinct,expected", [(True, [("1", "p", 21, 0)]), (False, [("1", "p", 21, 0), ("1", "p", 21, 1)])])
def test_partners_once_or_per_candidate(spark, rows, distinct, expected):
    tagged = spark.createDataFrame([("1", "a", 0, 0), ("1", "b", 0, 1), ("1", "c", 0, 2)],
                                   "customer_id string, article_id string, `1st_stage_strategy` int, `1st_stage_rank` int")
    partners = spark.createDataFrame([("a", "p"), ("b", "p")], "article_id string, partner_id string")
    assert rows(C.expand_pairs(tagged, partners, distinct)) == expected


def test_shuffled_negatives_keep_customers_and_articles(facts):
    tx = facts([("2020-01-01", f"c{i % 7}", f"a{i}") for i in range(60)])
    found = C.shuffled_negatives(tx, seed=1)
    pairs = {tuple(r) for r in found.collect()}
    actual = {(f"c{i % 7}", f"a{i}") for i in range(60)}
    assert actual < pairs and len(pairs) <= 120
    fake = pairs - actual
    assert {a for _, a in fake} <= {a for _, a in actual}
    assert found.exceptAll(C.shuffled_negatives(tx, seed=1)).isEmpty()


def test_all_strategies_with_limits(facts, spark, rows):
    tx = facts([("2020-03-31", "1", "a"), ("2020-03-01", "1", "b"), ("2019-06-01", "1", "c"), ("2018-01-01", "1", "d"),
                ("2020-03-30", "2", "b"), ("2020-03-30", "2", "b")])
    customers = spark.createDataFrame([("1", 0), ("2", 1), ("9", 1)], "customer_id string, customer_type int")
    articles = spark.createDataFrame([(x, "dep", "col") for x in "abcd"], "article_id string, department_name string, perceived_colour_master_name string")
    forecast = spark.createDataFrame([("n1", 5.0), ("n2", 7.0)], "article_id string, `1st_week_sales_pred` double")
    found = C.recommend(ids(spark, "1", "9"), tx, customers, articles, forecast, {"cf_a": 2, "pa_w": 0}, n_new=1)
    by = {}
    for r in found.collect():
        by.setdefault((r.customer_id, r["1st_stage_strategy"]), []).append((r["1st_stage_rank"], r.article_id))
    by = {k: [a for _, a in sorted(v)] for k, v in by.items()}
    assert by[("1", 0)] == ["a", "b"]                   # limit 2 of four single purchases
    assert by[("1", 6)] == ["a"] and by[("1", 11)] == ["a", "b"] and by[("1", 16)] == ["a", "b", "c"]
    assert by[("1", 4)] == ["b", "a", "c", "d"] == by[("9", 4)]
    assert ("1", 10) not in by                          # limit 0
    assert by[("9", 5)] == ["n2"]
    assert ("9", 1) not in by                           # no purchase, so not active in any window
    assert by[("1", 17)] == ["a", "b", "c"]
