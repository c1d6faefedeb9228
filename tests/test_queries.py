"""Registered queries against their SQL at the smallest scale; checks.run compares all of them."""

import os

import pytest

import __spark_entry__ as entry
from checks.run import compare, oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["label_encoded_articles", "customer_segments", "rolling_weeks", "customer_frequent_1m", "segment_frequent_1y",
          "favourite_colour_1w", "group_frequent_age", "bought_same_day_big_baskets", "recommend_21_strategies", "wide_union",
          "fallback_fill", "shuffled_negatives", "bagged_undersample", "article_weekly_2", "customer_weekly_3",
          "assembled_features", "baseline_map", "submission", "strategy_report", "regression_report", "weight_grid_sum",
          "detail_desc_tfidf", "popular_document_words", "price_mode"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return oracle(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert compare(got, con.execute(entry.oracle_sql()[name]).to_arrow_table()) == "ok"


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["map", "n_customers"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
