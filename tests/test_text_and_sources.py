import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.functions.joins import skew_join
from cartwheel.operators import models as M, profile as R, text as T
from cartwheel.sources import files as S, schemas

STOP = ["the", "and", "of"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_bigrams_skip_stop_words(spark, rows):
    counts = T.term_counts(docs(spark, "The Cat of x CAT été_1!", None, "a"), "id", "text", STOP)
    assert rows(counts) == [(0, "cat cat", 1), (0, "cat été_1", 1), (0, "cat", 2), (0, "été_1", 1)]


def test_tfidf_by_hand(spark):
    found = {(r.id, r.term): r.weight for r in T.tfidf(docs(spark, "red dress", "red red", ""), "id", "text", STOP, bigrams=False).collect()}
    red, dress = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    norm = math.hypot(red, dress)
    assert found == {(0, "red"): pytest.approx(red / norm), (0, "dress"): pytest.approx(dress / norm), (1, "red"): pytest.approx(1.0)}


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    dense = (rng.random((40, 12)) < 0.3) * rng.random((40, 12)) + np.outer(rng.random(40), rng.random(12))
    rows = [(i, f"t{j}", float(dense[i, j])) for i in range(40) for j in range(12) if dense[i, j] > 0]
    weights = spark.createDataFrame(rows, "id int, term string, weight double")
    got = T.truncated_svd(weights, "id", 3, "x", extra=5, rounds=6).toPandas().sort_values("id").to_numpy()[:, 1:]
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-3)


def test_popular_words(spark, rows):
    found = T.popular_words(docs(spark, "Cotton, cotton and the-silk", "silk cotton"), "text", STOP, 2)
    assert rows(found) == [("cotton", 3, 1), ("silk", 1, 2)]


def test_csv_keeps_leading_zeros(spark, tmp_path, facts, rows):
    S.write_csv(facts([("2020-01-01", "0a", "0108775015", 0.5, 2)]), str(tmp_path / "t"))
    frame = S.read_csv(spark, str(tmp_path / "t"), schemas.TRANSACTIONS)
    assert frame.schema == schemas.TRANSACTIONS and frame.first().article_id == "0108775015"
    assert S.read_csv(spark, str(tmp_path / "t"), schemas.TRANSACTIONS, ["article_id"]).columns == ["article_id"]


def test_month_filter_prunes_partitions(spark, tmp_path, facts, rows):
    S.write_facts(facts([("2020-01-31", "1", "a"), ("2020-02-01", "1", "b"), ("2020-02-20", "1", "c")]), str(tmp_path / "m"), 2)
    recent = S.read_facts_since(spark, str(tmp_path / "m"), "2020-02-10")
    assert rows(recent, "article_id") == [("c",)]
    assert "PartitionFilters: [isnotnull(month" in recent._jdf.queryExecution().executedPlan().toString()


def test_skew_join_equals_plain_join(spark, rows):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, w int")
    for how in ("left", "inner", "left_semi"):
        assert rows(skew_join(big, small, ["k"], how)) == rows(big.join(small, "k", how))


def test_a_hot_key_is_split_and_nothing_is_repeated(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        big = spark.range(20000).repartition(16).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = skew_join(big, small, ["k"], "inner")
        assert joined.agg(F.count(F.lit(1))).first()[0] == 20000 and joined.count() == 20000
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skewed=true" in plan.replace("skew=true", "skewed=true") and "Generate" not in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_profile(spark, rows):
    frame = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), (None, 2.0), ("b", None)], "k string, v double")
    assert rows(R.column_profile(frame)) == [("k", 5, 1, 2), ("v", 5, 1, 2)]
    assert rows(R.mode(frame, "v")) == [(1.0,)]
    assert rows(R.value_counts(frame, "k", keep_null=True)) == [("a", 2), ("b", 2), (None, 1)]
    assert rows(R.histogram(frame, "v", 10)) == [(0, 2), (9, 2)]
    assert R.overlap(frame.filter("k is not null"), frame.filter("k = 'b'"), "k").first() == (1, 1, 0)


def test_model_learns_and_reloads(spark, tmp_path):
    data = spark.createDataFrame([(str(i), str(i % 11), i % 10, "x" if i % 2 else "y", None if i % 4 else 1.0, int(i % 10 > 6)) for i in range(400)],
                                 "customer_id string, article_id string, f int, g string, h double, buy int")
    features = ["f", "g", "h"]
    model = M.fit_buy_model(data, data, features, rounds=3, leaves=6)
    scored = M.score(model, data, features).join(data, ["customer_id", "article_id"])
    low, high = (scored.filter(f"buy = {b}").agg({"pred": "avg"}).first()[0] for b in (0, 1))
    assert high > low + 0.3
    M.save_model(model, str(tmp_path / "model"))
    again = M.score_mean(M.load_models([str(tmp_path / "model")]), data, features)
    assert again.count() == 400
    assert M.importance([model]).first().feature == "f"


@pytest.mark.parametrize("passes", [1, 4, 7])
def test_tfidf_shuffles_terms_in_passes_that_are_gone(spark, monkeypatch, passes):
    docs = [("1", "red shirt red"), ("2", "blue shirt"), ("3", None), ("4", "red blue green"), (None, "red")]
    monkeypatch.setattr(T, "PASSES", passes)
    found = T.tfidf(spark.createDataFrame(docs, "id string, text string"), "id", "text", [])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    terms = [collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in ((t or "").split() for _, t in docs)]
    df = collections.Counter(t for c in terms for t in c)
    raw = [{t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()} for c in terms]
    want = {(k, t): w / math.sqrt(sum(x * x for x in r.values())) for (k, _), r in zip(docs, raw) for t, w in r.items()}
    got = {(r.id, r.term): r.weight for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
