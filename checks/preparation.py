"""Sources, preparation, filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.functions.dates import WINDOWS, in_slice, in_window, last_day, slice_grid, tag_windows, trailing, week_bucket
from cartwheel.operators import prepare as P
from cartwheel.sources import files as S, schemas
from checks.views import CATEGORIES, GROUPS, TRAIN_START, VALID_END, VALID_START, Views, since, sql

QUERIES, SQL = {}, {}


def query(sql_text: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
        if sql_text is not None:
            SQL[fn.__name__] = sql_text
        return fn
    return add


# ---- sources and sinks ----------------------------------------------------------------

@query(sql("SELECT * FROM tx", "tx"))
def csv_round_trip(v):
    path = v.scratch("transactions")
    S.write_csv(v.transactions, path)
    return S.read_csv(v.spark, path, schemas.TRANSACTIONS)


@query(sql("SELECT customer_id, article_id FROM tx", "tx"))
def csv_column_subset(v):
    path = v.scratch("transactions")
    S.write_csv(v.transactions, path)
    return S.read_csv(v.spark, path, schemas.TRANSACTIONS, ["customer_id", "article_id"])


@query(sql("SELECT customer_id, count(*) AS n FROM hist GROUP BY 1", "hist"))
def stage_reuse(v):
    staged = S.write_stage(v.history(), v.scratch("history"))
    return staged.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT * FROM tx WHERE t_dat >= DATE '2001-06-15'", "tx"))
def monthly_facts_since(v):
    path = v.scratch("facts")
    S.write_facts(v.transactions, path, files_per_month=1)
    return S.read_facts_since(v.spark, path, "2001-06-15")


@query(sql(f"""
    SELECT customer_id, article_id, CAST(pred AS DOUBLE) AS pred, exp FROM (
      SELECT customer_id, article_id, count(*) AS pred, 'lifetime' AS exp FROM tx GROUP BY 1, 2
      UNION ALL
      SELECT customer_id, article_id, count(*), 'recent' FROM tx WHERE {since('1m', 'tx')} GROUP BY 1, 2)""", "tx"))
def tagged_experiments(v):
    paths = {}
    for exp, window in (("lifetime", "all"), ("recent", "1m")):
        rows = trailing(v.transactions, window)
        paths[exp] = v.scratch(exp)
        S.write_csv(rows.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("pred")), paths[exp])
    return S.read_tagged(v.spark, paths, schemas.OOF)


# ---- values and encodings -------------------------------------------------------------

@query(sql("""SELECT article_id, row_number() OVER (ORDER BY ('0x' || substr(md5('0|' || article_id), 1, 8))::BIGINT, article_id) - 1 AS article_id_idx
    FROM (SELECT DISTINCT article_id FROM tx)""", "tx"))
def surrogate_ids(v):
    return P.surrogate_ids(v.transactions, "article_id")


@query(sql("""SELECT customer_id, replace(fashion_news_frequency, 'None', 'NONE') AS fashion_news_frequency FROM raw_cust""", "raw_cust"))
def normalised_news_frequency(v):
    return (P.normalise_value(v.raw_customers, "fashion_news_frequency", "None", "NONE")
            .select("customer_id", "fashion_news_frequency"))


@query(sql("""SELECT customer_id, CAST(floor(age / 10) * 10 AS INTEGER) AS age10, CAST(floor(age / 5) * 5 AS INTEGER) AS age5 FROM raw_cust""", "raw_cust"))
def age_bins(v):
    return v.raw_customers.select("customer_id", P.age_bin("age", 10).alias("age10"), P.age_bin("age", 5).alias("age5"))


@query(sql("UNION ALL ".join(
    f"""SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT coalesce({c}, '') AS value FROM art) """ for c in CATEGORIES), "art"))
def label_dictionary(v):
    return P.label_codes(v.articles, CATEGORIES)


@query(sql("""SELECT 'customer_id' AS "column", customer_id AS value, CAST(row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT customer_id FROM tx)""", "tx"))
def large_label_dictionary(v):
    return P.label_codes(v.transactions, ["customer_id"], large=True)


@query(sql("SELECT article_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, '')) - 1 AS INTEGER) AS {c}" for c in CATEGORIES) + " FROM art", "art"))
def label_encoded_articles(v):
    return P.label_encode(v.articles.select("article_id", *CATEGORIES), CATEGORIES)


@query(sql("""SELECT customer_id, CAST(dense_rank() OVER (ORDER BY coalesce(club_member_status, '')) - 1 AS INTEGER) AS club_member_status,
    CAST(dense_rank() OVER (ORDER BY coalesce(CAST(age AS INTEGER)::VARCHAR, '')) - 1 AS INTEGER) AS age FROM raw_cust""", "raw_cust"))
def label_encoded_with_nulls(v):
    rows = v.raw_customers.select("customer_id", "club_member_status", F.col("age").cast("int").alias("age"))
    return P.label_encode(rows, ["club_member_status", "age"])


@query(sql("SELECT article_id, " + ", ".join(
    f"CAST(index_group_name = '{g}' AS INTEGER) AS \"{g}\"" for g in GROUPS) + " FROM art", "art"))
def index_group_flags(v):
    return v.articles.select("article_id", *[P.enum_flag("index_group_name", g).alias(g) for g in GROUPS])


@query(sql("""SELECT customer_id, age10, segment, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS customer_type FROM seg_text""", "seg_text"))
def customer_segments(v):
    clean = P.normalise_value(v.raw_customers, "fashion_news_frequency", "None", "NONE")
    return P.customer_segment(clean).select("customer_id", "age10", "segment", "customer_type")


@query(sql("SELECT * FROM wide", "wide"))
def denormalised_history(v):
    return v.wide


@query(sql("""SELECT tx.t_dat, tx.customer_id, tx.article_id, fashion_news_frequency, age FROM tx LEFT JOIN cust10 USING (customer_id)""", "tx", "cust10"))
def denormalised_three_columns(v):
    rows = v.transactions.select("t_dat", "customer_id", "article_id")
    clean = P.normalise_value(v.raw_customers, "fashion_news_frequency", "None", "NONE")
    return (P.denormalise(rows, clean, v.articles, ["fashion_news_frequency", "age"], [])
            .select("t_dat", "customer_id", "article_id", "fashion_news_frequency", "age"))


# ---- filters --------------------------------------------------------------------------

@query(sql("SELECT article_id, count(*) AS n FROM tx WHERE t_dat > DATE '2000-09-20' GROUP BY 1", "tx"))
def recent_facts(v):
    return P.recent_facts(v.transactions, "2000-09-20").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql(" UNION ALL ".join(
    f"SELECT '{w}' AS win, customer_id, count(*) AS n FROM tx WHERE {since(w, 'tx')} GROUP BY 2" for w in WINDOWS), "tx"))
def trailing_windows(v):
    end = last_day(v.transactions)
    tagged = tag_windows(v.transactions, {w: in_window(end, w) for w in WINDOWS})
    return tagged.groupBy("win", "customer_id").agg(F.count(F.lit(1)).alias("n"))


def _slice_sql(start, length, relation="tx"):
    shift = {"1w": "INTERVAL 7 DAY", "1m": "INTERVAL 1 MONTH", "1y": "INTERVAL 12 MONTH"}
    if start == "all":
        return "TRUE"
    first = f"CAST((SELECT max(t_dat) FROM {relation}) - {shift[start]} AS DATE)"
    if length == "all":
        return f"t_dat >= {first}"
    return f"t_dat >= {first} AND t_dat <= CAST({first} + {shift[length]} AS DATE)"


@query(sql(" UNION ALL ".join(
    f"SELECT '{name}' AS win, article_id, count(*) AS n FROM tx WHERE {_slice_sql(s, l)} GROUP BY 2"
    for name, (s, l) in slice_grid().items()), "tx"))
def slice_windows(v):
    end = last_day(v.transactions)
    tagged = tag_windows(v.transactions, {name: in_slice(end, s, l) for name, (s, l) in slice_grid().items()})
    return tagged.groupBy("win", "article_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT week, count(*) AS n, min(t_dat) AS first_day, max(t_dat) AS last_day FROM (
      SELECT t_dat, CAST(floor(((SELECT max(t_dat) FROM tx) - t_dat) / 7) AS INTEGER) AS week FROM tx) GROUP BY 1""", "tx"))
def week_buckets(v):
    rows = v.transactions
    return (rows.withColumn("week", week_bucket(last_day(rows))).groupBy("week")
            .agg(F.count(F.lit(1)).alias("n"), F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day")))


SPLITS = P.rolling_splits(TRAIN_START, VALID_START, 3)


@query(sql("""SELECT s.iter, CASE WHEN t_dat < hist_end THEN 'history' ELSE 'target' END AS part, count(*) AS n,
      count(DISTINCT customer_id) AS n_customers, max(t_dat) AS last_day
    FROM tx JOIN s ON t_dat < target_end GROUP BY 1, 2""", "tx",
    s="SELECT * FROM (VALUES " + ", ".join(
        f"({s.iter}, DATE '{s.hist_end}', DATE '{s.target_end}')" for s in SPLITS) + ") t(iter, hist_end, target_end)"))
def rolling_weeks(v):
    tagged = P.tag_splits(v.transactions, SPLITS)
    return tagged.groupBy("iter", "part").agg(F.count(F.lit(1)).alias("n"),
                                              F.count_distinct("customer_id").alias("n_customers"), F.max("t_dat").alias("last_day"))


@query(sql(f"""SELECT t_dat < DATE '{VALID_START}' AS is_history, count(*) AS n, min(t_dat) AS first_day, max(t_dat) AS last_day
    FROM tx WHERE t_dat <= DATE '{VALID_END}' GROUP BY 1""", "tx"))
def holdout_split(v):
    history, target = P.holdout(v.transactions, VALID_START, VALID_END)
    stats = [F.count(F.lit(1)).alias("n"), F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day")]
    return (history.agg(*stats).withColumn("is_history", F.lit(True))
            .unionByName(target.agg(*stats).withColumn("is_history", F.lit(False))))


@query(sql("""SELECT fc.* FROM fc, (SELECT min(t_dat) lo, max(t_dat) hi FROM tx WHERE t_dat BETWEEN DATE '1995-06-01' AND DATE '1995-06-30')
    WHERE "1st_week_sales_dat" BETWEEN lo AND hi""", "tx", "fc"))
def forecast_of_target_period(v):
    june = v.transactions.filter(F.col("t_dat").between(F.lit("1995-06-01").cast("date"), F.lit("1995-06-30").cast("date")))
    return P.forecast_in_period(v.forecast, june)


@query(sql("""SELECT * FROM fc WHERE "1st_week_sales_dat" >= DATE '1995-07-01'""", "fc"))
def forecast_from_day(v):
    return P.forecast_from(v.forecast, "1995-07-01")


@query(sql("SELECT customer_id, article_id, t_dat FROM hist WHERE customer_id IN (SELECT customer_id FROM targ)", "hist", "targ"))
def history_of_target_customers(v):
    return P.members(v.history(), v.target(), "customer_id").select("customer_id", "article_id", "t_dat")


@query(sql("""SELECT article_id, department_name FROM art
    WHERE article_id NOT IN (SELECT article_id FROM tx WHERE t_dat > DATE '2001-05-03')""", "art", "tx"))
def never_sold_articles(v):
    return P.non_members(v.articles, P.recent_facts(v.transactions, "2001-05-03"), "article_id").select("article_id", "department_name")


@query(sql("""SELECT customer_id, customer_total_cnt, customer_total_cnt IS NOT NULL AS warm
    FROM (SELECT DISTINCT customer_id FROM tx) LEFT JOIN
      (SELECT customer_id, count(*) AS customer_total_cnt FROM tx WHERE t_dat > DATE '2001-05-03' GROUP BY 1) USING (customer_id)""", "tx"))
def warm_and_cold_customers(v):
    recent = P.recent_facts(v.transactions, "2001-05-03").groupBy("customer_id").agg(F.count(F.lit(1)).alias("customer_total_cnt"))
    warm, cold = P.warm_cold(v.transactions.select("customer_id").distinct().join(recent, "customer_id", "left"))
    return warm.withColumn("warm", F.lit(True)).unionByName(cold.withColumn("warm", F.lit(False)))


@query(sql("""SELECT article_id, count(*) AS n FROM wide WHERE index_group_name = 'MEDIUM' GROUP BY 1""", "wide"))
def sub_population(v):
    rows = v.wide_with(article_cols=["index_group_name"])
    return P.equal_to(rows, "index_group_name", "MEDIUM").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql(" UNION ALL ".join(
    f"""SELECT customer_id || '_{s.iter}' AS customer_id, article_id, count(*) AS n FROM tx
        WHERE t_dat >= DATE '{s.hist_end}' AND t_dat < DATE '{s.target_end}' GROUP BY 1, 2""" for s in SPLITS), "tx"))
def week_ranking_groups(v):
    result = None
    for s in SPLITS:
        part = P.iteration_id(P.target_of(v.transactions, s), s.iter)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
