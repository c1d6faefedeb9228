from pyspark.sql import functions as F

from cartwheel.functions.dates import last_day, tag_windows, in_window, trailing, week_bucket, window_slice
from cartwheel.operators import prepare as P


def test_candidate_window_includes_its_first_day(facts, rows):
    tx = facts([("2020-03-31", "c", "a"), ("2020-03-24", "c", "b"), ("2020-03-23", "c", "d"),
                ("2020-02-29", "c", "e"), ("2020-02-28", "c", "f")])
    assert rows(trailing(tx, "1w"), "article_id") == [("a",), ("b",)]
    assert rows(trailing(tx, "1m"), "article_id") == [("a",), ("b",), ("d",), ("e",)]     # 31 March - 1 month = 29 February
    assert rows(trailing(tx, "1w", "2020-03-30"), "article_id") == [("a",), ("b",), ("d",)]


def test_feature_weeks_exclude_their_lower_bound(facts, rows):
    tx = facts([("2020-03-31", "c", "a"), ("2020-03-25", "c", "b"), ("2020-03-24", "c", "d"), ("2020-03-17", "c", "e")])
    assert rows(tx.withColumn("w", week_bucket(last_day(tx))), "article_id", "w") == [("a", 0), ("b", 0), ("d", 1), ("e", 2)]


def test_slice_has_both_ends(facts, rows):
    tx = facts([("2020-03-31", "c", "a"), ("2020-02-29", "c", "b"), ("2020-03-07", "c", "d"), ("2020-03-08", "c", "e")])
    assert rows(window_slice(tx, "1m", "1w"), "article_id") == [("b",), ("d",)]
    assert window_slice(tx, "all", "1w").count() == 4


def test_windows_tagged_in_one_pass(facts, rows):
    tx = facts([("2020-03-31", "c", "a"), ("2020-03-01", "c", "b")])
    end = last_day(tx)
    tagged = tag_windows(tx, {w: in_window(end, w) for w in ("all", "1w", "1m")})
    assert rows(tagged, "article_id", "win") == [("a", "1m"), ("a", "1w"), ("a", "all"), ("b", "1m"), ("b", "all")]


def test_rolling_weeks_step_eight_days(facts):
    splits = P.rolling_splits("2020-09-09", "2020-09-16", 3)
    assert [(s.hist_end, s.target_end) for s in splits] == [
        ("2020-09-09", "2020-09-16"), ("2020-09-01", "2020-09-08"), ("2020-08-24", "2020-08-31")]
    tx = facts([("2020-09-08", "c", "a"), ("2020-09-09", "c", "b"), ("2020-09-16", "c", "d")])
    assert P.history_of(tx, splits[0]).count() == 1
    assert P.target_of(tx, splits[0]).count() == 1
    tagged = P.tag_splits(tx, splits).groupBy("iter", "part").count().collect()
    assert {(r["iter"], r["part"]): r["count"] for r in tagged} == {(0, "history"): 1, (0, "target"): 1}


def test_holdout_end_is_included(facts):
    tx = facts([("2020-09-15", "c", "a"), ("2020-09-16", "c", "b"), ("2020-09-22", "c", "d"), ("2020-09-23", "c", "e")])
    history, target = P.holdout(tx, "2020-09-16", "2020-09-22")
    assert (history.count(), target.count()) == (1, 2)


def people(spark):
    return spark.createDataFrame(
        [("1", 1.0, None, "ACTIVE", "None", 23.0, "p"), ("2", None, 1.0, None, "NONE", None, "q"), ("3", None, None, "ACTIVE", "Regularly", 39.0, None)],
        "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age double, postal_code string")


def test_encodings_and_null_values(spark, rows):
    frame = P.normalise_value(people(spark), "fashion_news_frequency", "None", "NONE")
    assert rows(frame, "fashion_news_frequency") == [("NONE",), ("NONE",), ("Regularly",)]
    assert rows(P.label_codes(frame, ["club_member_status"]), "value", "code") == [("", 0), ("ACTIVE", 1)]
    assert rows(P.label_encode(frame, ["club_member_status", "postal_code"]), "customer_id", "club_member_status", "postal_code") == [
        ("1", 1, 1), ("2", 0, 2), ("3", 1, 0)]
    ages = frame.select("customer_id", P.age_bin("age", 10).alias("d"), P.age_bin("age", 5).alias("f"))
    assert rows(ages) == [("1", 20, 20), ("2", None, None), ("3", 30, 35)]


def test_segment_joins_flags_and_codes(spark, rows):
    frame = P.customer_segment(P.normalise_value(people(spark), "fashion_news_frequency", "None", "NONE"))
    # flags, then codes of status ('' 0, ACTIVE 1), news (NONE 0, Regularly 1), decade ('' 0, 20 1, 30 2)
    assert rows(frame, "customer_id", "segment", "customer_type") == [("1", "10101", 2), ("2", "01000", 1), ("3", "00112", 0)]


def test_surrogate_ids_are_dense(spark):
    frame = spark.range(500).select(F.concat(F.lit("x"), "id").alias("k")).union(spark.range(5).select(F.concat(F.lit("x"), "id")))
    ids = [r.k_idx for r in P.surrogate_ids(frame, "k").collect()]
    assert sorted(ids) == list(range(500))


def test_membership(facts, spark, rows):
    tx = facts([("2020-01-01", "1", "a"), ("2020-01-01", "2", "b"), ("2020-01-02", "1", "a")])
    ids = spark.createDataFrame([("1",), ("1",)], "customer_id string")
    assert rows(P.members(tx, ids, "customer_id"), "article_id") == [("a",), ("a",)]
    articles = spark.createDataFrame([("a",), ("z",)], "article_id string")
    assert rows(P.non_members(articles, tx, "article_id")) == [("z",)]


def test_large_dictionaries_get_the_same_codes(spark):
    frame = spark.range(3000).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(1000))).alias("a"),
                                     F.when(F.col("id") % 5 > 0, F.concat(F.lit("z"), F.col("id") % 40)).alias("b"))
    small, large = P.label_codes(frame, ["a", "b"]), P.label_codes(frame, ["a", "b"], large=True)
    assert small.exceptAll(large).isEmpty() and large.count() == small.count() == 1033
