"""Stage tables in the shared folder."""

import os
import time

from pyspark.sql import functions as F

from cartwheel.functions import stage


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_joined_and_grouped_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts = spark.range(5000).select((F.col("id") % 700).cast("string").alias("customer_id"), "id")
        left = stage.cut_by(facts, "customer_id")
        right = stage.cut_by(facts.groupBy("customer_id").agg(F.count("*").alias("n")), "customer_id")
        joined = left.join(right, "customer_id")
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(left.groupBy("customer_id").count())
        assert "Exchange" in plan(facts.groupBy("customer_id").count())
        assert joined.agg(F.sum("n")).first()[0] == sum(n * n for n in (5000 // 700 + (i < 5000 % 700) for i in range(700)))
        # another side that is no such table is the only one to move
        assert plan(left.join(facts.withColumnRenamed("id", "other"), "customer_id")).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_can_be_deleted_before_the_session_ends(spark):
    for stored in (stage.cut(spark.range(3), "zstd"), stage.cut_by(spark.range(3), "id", buckets=2)):
        folder = stored.stage_folder.removeprefix("file:").replace("//", "/")
        assert os.path.isdir(folder) and stored.count() == 3
        stage.discard(stored)
        assert not os.path.isdir(folder)


def test_a_stage_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before, setting = files(), spark.conf.get(stage._CLEANUP, None)
    stored = stage.cut(spark.range(20_000).select((F.col("id") % 999).alias("k")).groupBy("k").agg(F.count("*").alias("n")))
    until = time.time() + 20
    while (left := {f for f in files() - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)                 # they go in the background
    assert not left and stored.count() == 999 and spark.conf.get(stage._CLEANUP, None) == setting
