"""Labels, sampling and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.functions.stage import cut
from cartwheel.operators import candidates as C, features as X, labels as L, prepare as P
from checks import candidate_sql as Q
from checks.views import CATEGORIES, FORECAST_AFTER, GROUPS, SEGMENT_COLUMNS, VALID_END, VALID_START, Views, q6, r6, sql

QUERIES, SQL = {}, {}
WINDOWS = ("all", "1w", "1m", "1y")
KEYS = ["customer_id", "article_id", C.STRATEGY, C.RANK]


def add(name, fn, text=None):
    QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
    if text is not None:
        SQL[name] = text


def candidates(v):
    return C.frequent_and_popular(v.history(), v.target(), 12, WINDOWS)


def labelled(v):
    return L.add_labels(candidates(v), v.target())


CAND = Q.simple_tagged(WINDOWS)
LABELLED = """SELECT c.customer_id, c.article_id, s AS "1st_stage_strategy", r AS "1st_stage_rank",
    CASE WHEN t.article_id IS NULL THEN 0 ELSE 1 END AS buy
    FROM cand c LEFT JOIN truth t ON c.customer_id = t.customer_id AND c.article_id = t.article_id"""

# ---- labels and sampling --------------------------------------------------------------

add("labels", labelled, sql(LABELLED, "hist", "targ", "truth", cand=CAND))


def _hash(seed):
    return f"""('0x' || substr(md5({seed} || '|' || customer_id || '|' || article_id || '|' || "1st_stage_strategy" || '|' || "1st_stage_rank"), 1, 8))::BIGINT"""


def _sampled(ratio, seed="'42'", source="lab", partition=""):
    return f"""SELECT * FROM {source} WHERE buy = 1 UNION ALL
        SELECT * FROM (SELECT * FROM {source} WHERE buy = 0
          QUALIFY row_number() OVER ({partition} ORDER BY {_hash(seed)}, customer_id, article_id, "1st_stage_strategy", "1st_stage_rank")
            <= (SELECT floor(sum(buy) * {ratio}) FROM lab))"""


for _ratio in (1, 8, 16):
    add(f"undersample_{_ratio}", lambda v, r=_ratio: L.undersample(labelled(v), KEYS, float(r)),
        sql(_sampled(_ratio), "hist", "targ", "truth", cand=CAND, lab=LABELLED))
add("bagged_undersample", lambda v: L.bagged_undersample(labelled(v), KEYS, 4.0, [0, 1, 2, 3, 4]),
    sql(_sampled(4, "seed", "seeded", "PARTITION BY seed"), "hist", "targ", "truth", cand=CAND, lab=LABELLED,
        seeded="SELECT * FROM lab CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS seed)"))
add("ranking_group_sizes", lambda v: L.group_sizes(labelled(v)),
    sql("SELECT customer_id, count(*) AS n_rows FROM cand GROUP BY 1", "hist", "targ", cand=CAND))
add("folds", lambda v: L.assign_folds(v.articles.select("article_id"), "article_id"),
    sql("SELECT article_id, CAST(('0x' || substr(md5('42|' || article_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM art", "art"))
add("truth_lists", lambda v: L.truth_lists(v.target()),
    sql("SELECT customer_id, list(article_id ORDER BY article_id) AS article_ids FROM truth GROUP BY 1", "truth"))
add("truth_pairs_all_history", lambda v: L.truth_pairs(v.transactions),
    sql("SELECT DISTINCT customer_id, article_id FROM tx", "tx"))


# ---- aggregates -----------------------------------------------------------------------

def rounded(frame, *endings):
    """Averages and deviations to six decimals; counts, extremes and ratios of counts are exact."""
    return frame.withColumns({c: r6(f"`{c}`") for c in frame.columns if any(e in c for e in endings)})


def aged(v):
    return P.denormalise(v.history(), v.raw_customers, v.articles, ["age"], [])


ROUND = ("price_mean", "age_mean", "age_std")


def article_stats(rel, end, prefix="", suffix="", median=False, where="TRUE"):
    """SQL of the article statistics of one relation."""
    name = lambda text: f'"{prefix}{text}{suffix}"'
    cols = [f"CAST({end} - max(t_dat) AS INTEGER) AS {name('article_total_latest_buy')}",
            f"CAST({end} - min(t_dat) AS INTEGER) AS {name('article_total_1st_buy')}",
            f"count(*) AS {name('article_total_cnt')}",
            f"max(price) AS {name('article_price_max')}, min(price) AS {name('article_price_min')}, {q6('avg(price)')} AS {name('article_price_mean')}",
            f"max(age) AS {name('article_age_max')}, min(age) AS {name('article_age_min')}, {q6('avg(age)')} AS {name('article_age_mean')}",
            f"{q6('stddev_samp(age)')} AS {name('article_age_std')}"]
    if median:
        cols.append(f"median(age) AS {name('article_age_median')}")
    return f"SELECT article_id, {', '.join(cols)} FROM {rel} WHERE {where} GROUP BY 1"


END = "(SELECT max(t_dat) FROM hist_wide)"


def week_of(i):
    return f"t_dat > {END} - {7 * (i + 1)} AND t_dat <= {END} - {7 * i}"


def bucket_end(i):
    return f"(SELECT max(t_dat) FROM hist_wide WHERE {week_of(i)})"


add("article_attributes", lambda v: X.article_attributes(v.articles, CATEGORIES),
    sql("SELECT article_id, " + ", ".join(CATEGORIES) + " FROM art", "art"))
add("article_lifetime", lambda v: rounded(X.article_lifetime(aged(v)), *ROUND),
    sql(article_stats("hist_wide", END), "hist_wide"))


def _joined(key, parts):
    """SQL: the relations joined on a key, every key of any of them once."""
    names = [f"p{i}" for i in range(len(parts))]
    body = f"SELECT * FROM {names[0]}" + "".join(f" FULL JOIN {n} USING ({key})" for n in names[1:])
    return body, dict(zip(names, parts))


for _weeks in (2, 3):
    _body, _parts = _joined("article_id", [article_stats("hist_wide", bucket_end(i), "", f"_{i + 1}weekago", True, week_of(i)) for i in range(_weeks)])
    add(f"article_weekly_{_weeks}", lambda v, n=_weeks: rounded(X.article_weekly(aged(v), n), *ROUND), sql(_body, "hist_wide", **_parts))
_body, _parts = _joined("article_id", [article_stats("hist_wide", END, p, where=f"sales_channel_id = {c}") for p, c in (("online_", 2), ("shop_", 1))])
add("article_by_channel", lambda v: rounded(X.article_by_channel(aged(v)), *ROUND), sql(_body, "hist_wide", **_parts))


def grouped(v):
    return v.history(v.wide_with(article_cols=["index_group_name"]))


def customer_stats(end, suffix="", where="TRUE", channels=False):
    name = lambda text: f'"{text}{suffix}"'
    cols = [f"count(*) AS {name('customer_total_cnt')}",
            f"CAST({end} - max(t_dat) AS INTEGER) AS {name('customer_total_latest_buy')}",
            f"CAST({end} - min(t_dat) AS INTEGER) AS {name('customer_total_1st_buy')}",
            f"max(price) AS {name('customer_price_max')}, min(price) AS {name('customer_price_min')}, {q6('avg(price)')} AS {name('customer_price_mean')}"]
    share = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"
    cols += [f"{share(chr(34) + 'index_group_name' + chr(34) + ' = ' + repr(g))} AS {name(g)}" for g in GROUPS]
    if channels:
        cols += [f"{share('sales_channel_id = 1')} AS {name('shop')}", f"{share('sales_channel_id = 2')} AS {name('online')}"]
    return f"SELECT customer_id, {', '.join(cols)} FROM hist_wide WHERE {where} GROUP BY 1"


add("customer_attributes", lambda v: X.customer_attributes(v.customers), sql("SELECT * FROM cust", "cust"))
add("customer_lifetime", lambda v: rounded(X.customer_lifetime(grouped(v), GROUPS), "price_mean"),
    sql(customer_stats(END), "hist_wide"))
add("customer_lifetime_channels", lambda v: rounded(X.customer_lifetime(grouped(v), GROUPS, channels=True), "price_mean"),
    sql(customer_stats(END, channels=True), "hist_wide"))
for _weeks in (2, 3):
    _body, _parts = _joined("customer_id", [customer_stats(bucket_end(i), f"_{i + 1}weekago", week_of(i)) for i in range(_weeks)])
    add(f"customer_weekly_{_weeks}", lambda v, n=_weeks: rounded(X.customer_weekly(grouped(v), n, GROUPS), "price_mean"),
        sql(_body, "hist_wide", **_parts))

# ---- pairs and rates ------------------------------------------------------------------

add("pair_history", lambda v: X.pair_history(candidates(v), v.history()),
    sql("""SELECT customer_id, article_id, count(*) AS count, CAST((SELECT max(t_dat) FROM hist) - min(t_dat) AS INTEGER) AS "1st_buy_date_diff",
        CAST((SELECT max(t_dat) FROM hist) - max(t_dat) AS INTEGER) AS latest_buy_date_diff
        FROM hist JOIN (SELECT DISTINCT customer_id, article_id FROM cand) USING (customer_id, article_id) GROUP BY 1, 2""", "hist", "targ", cand=CAND))
_BOUGHT = "SELECT hist.* FROM hist JOIN (SELECT DISTINCT customer_id, article_id FROM cand) USING (customer_id, article_id)"
add("pair_trailing_counts", lambda v: X.pair_trailing_counts(candidates(v), v.history()),
    sql("SELECT customer_id, article_id, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE t_dat >= CAST((SELECT max(t_dat) FROM bought) - INTERVAL {i} AS DATE)), 0) AS {n}"
        for i, n in (("7 DAY", "l1w_cnt"), ("1 MONTH", "l1m_cnt"), ("12 MONTH", "l1y_cnt"))) + " FROM bought GROUP BY 1, 2",
        "hist", "targ", cand=CAND, bought=_BOUGHT))


def rates_sql(key, columns):
    return " UNION ALL ".join(
        f"""SELECT {key}, '{c}' AS attribute, CAST("{c}" AS VARCHAR) AS value,
            CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {key}) AS rate FROM hist_wide WHERE "{c}" IS NOT NULL GROUP BY 1, "{c}" """
        for c in columns)


add("same_attribute_rates", lambda v: X.same_article_type_rates(v.history(v.wide_with(article_cols=CATEGORIES)), CATEGORIES),
    sql(rates_sql("customer_id", CATEGORIES), "hist_wide"))
_SEGMENTS = ["club_member_status", "fashion_news_frequency", "age10", "customer_type"]
add("same_buyer_rates", lambda v: X.same_customer_type_rates(v.history(v.wide_with(customer_cols=_SEGMENTS)), _SEGMENTS),
    sql(rates_sql("article_id", _SEGMENTS), "hist_wide"))


def _rate_joins(key, columns, side, suffix):
    return (f"SELECT c.customer_id, c.article_id, c.s AS \"1st_stage_strategy\", c.r AS \"1st_stage_rank\", "
            + ", ".join(f'd."{x}"' for x in columns) + ", " + ", ".join(f'q{i}.rate AS "{x}{suffix}"' for i, x in enumerate(columns))
            + f" FROM cand c LEFT JOIN {side} d USING ({'article_id' if key == 'customer_id' else 'customer_id'})"
            + "".join(f" LEFT JOIN (SELECT * FROM rates WHERE attribute = '{x}') q{i} ON q{i}.{key} = c.{key} AND q{i}.value = CAST(d.\"{x}\" AS VARCHAR)"
                      for i, x in enumerate(columns)))


add("candidates_with_attribute_rates",
    lambda v: X.add_same_article_type_rates(candidates(v).join(v.articles.select("article_id", *CATEGORIES), "article_id", "left"),
                                            v.history(v.wide_with(article_cols=CATEGORIES)), CATEGORIES),
    sql(_rate_joins("customer_id", CATEGORIES, "art", "_customer_buy_rate"), "hist", "targ", "hist_wide", cand=CAND,
        rates=rates_sql("customer_id", CATEGORIES)))
add("candidates_with_buyer_rates",
    lambda v: X.add_same_customer_type_rates(candidates(v).join(v.customers.select("customer_id", *_SEGMENTS), "customer_id", "left"),
                                             v.history(v.wide_with(customer_cols=_SEGMENTS)), _SEGMENTS),
    sql(_rate_joins("article_id", _SEGMENTS, "cust", "_article_buy_rate"), "hist", "targ", "hist_wide", cand=CAND,
        rates=rates_sql("article_id", _SEGMENTS)))
add("candidates_with_flag_rates",
    lambda v: X.add_same_customer_type_rates(candidates(v).join(v.customers.select("customer_id", "FN", "Active"), "customer_id", "left"),
                                             v.history(v.wide_with(customer_cols=["FN", "Active"])), ["FN", "Active"]),
    sql(_rate_joins("article_id", ["FN", "Active"], "cust", "_article_buy_rate"), "hist", "targ", "hist_wide", cand=CAND,
        rates=rates_sql("article_id", ["FN", "Active"])))
add("new_article_features", lambda v: X.new_article_features(v.forecast),
    sql('SELECT article_id, 1 AS new_article, "1st_week_sales_pred" FROM fc', "fc"))
for _key in ("customer_id", "article_id"):
    add(f"repeat_rate_{_key[:-3]}", lambda v, k=_key: X.repeat_rate(v.history(), k),
        sql(f"""SELECT {_key}, CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*) AS {_key[:-3]}_repeat_rate FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id, article_id ORDER BY t_dat) AS n
            FROM (SELECT DISTINCT t_dat, customer_id, article_id FROM hist)) GROUP BY 1""", "hist"))
add("candidate_article_age",
    lambda v: rounded(X.candidate_age_of_articles(candidates(v).join(
        X.article_lifetime(aged(v)).select("article_id", "article_total_1st_buy"), "article_id", "left")), "_mean"),
    sql(f"""SELECT customer_id, article_id, s AS "1st_stage_strategy", r AS "1st_stage_rank", f AS article_total_1st_buy,
        {q6('avg(coalesce(f, 0)) OVER (PARTITION BY customer_id)')} AS customer_article_total_1st_buy_mean,
        CAST(median(coalesce(f, 0)) OVER (PARTITION BY customer_id) AS DOUBLE) AS customer_article_total_1st_buy_median
        FROM cand LEFT JOIN (SELECT article_id, CAST((SELECT max(t_dat) FROM hist) - min(t_dat) AS INTEGER) AS f FROM hist GROUP BY 1) USING (article_id)""",
        "hist", "targ", cand=CAND))

# ---- first sales ----------------------------------------------------------------------

add("first_sale_offsets", lambda v: X.first_sale(v.transactions).select("t_dat", "customer_id", "article_id", "1st_tran_dat", "1st_tran_dat_diff"),
    sql("""SELECT t_dat, customer_id, article_id, min(t_dat) OVER (PARTITION BY article_id) AS "1st_tran_dat",
        CAST(t_dat - min(t_dat) OVER (PARTITION BY article_id) AS INTEGER) AS "1st_tran_dat_diff" FROM tx""", "tx"))
add("first_week_sales", lambda v: X.first_week_sales(v.transactions, FORECAST_AFTER), sql("SELECT * FROM fws", "fws"))

# ---- assembly -------------------------------------------------------------------------

def assembled(v):
    frame = X.add_features(cut(labelled(v)), v.history(), v.articles, v.customers, v.forecast, weeks=2, groups=GROUPS, categories=CATEGORIES)
    return rounded(frame, "price_mean", "age_mean", "age_std")


_parts = {
    "lab": LABELLED, "a0": article_stats("hist_wide", END),
    "a1": article_stats("hist_wide", bucket_end(0), "", "_1weekago", True, week_of(0)),
    "a2": article_stats("hist_wide", bucket_end(1), "", "_2weekago", True, week_of(1)),
    "c0": customer_stats(END), "c1": customer_stats(bucket_end(0), "_1weekago", week_of(0)),
    "c2": customer_stats(bucket_end(1), "_2weekago", week_of(1)),
    "ph": """SELECT customer_id, article_id, count(*) AS count, CAST((SELECT max(t_dat) FROM hist) - min(t_dat) AS INTEGER) AS "1st_buy_date_diff",
        CAST((SELECT max(t_dat) FROM hist) - max(t_dat) AS INTEGER) AS latest_buy_date_diff FROM hist GROUP BY 1, 2""",
    "rates": rates_sql("customer_id", CATEGORIES)}
add("assembled_features", assembled, sql(
    f"SELECT l.*, art.* EXCLUDE (article_id, prod_name, detail_desc), a0.* EXCLUDE (article_id), a1.* EXCLUDE (article_id), a2.* EXCLUDE (article_id), "
    "CASE WHEN fc.article_id IS NOT NULL THEN 1 END AS new_article, \"1st_week_sales_pred\", cust.* EXCLUDE (customer_id), c0.* EXCLUDE (customer_id), "
    "c1.* EXCLUDE (customer_id), c2.* EXCLUDE (customer_id), ph.* EXCLUDE (customer_id, article_id), "
    + ", ".join(f"q{i}.rate AS {c}_customer_buy_rate" for i, c in enumerate(CATEGORIES))
    + " FROM lab l LEFT JOIN art ON art.article_id = l.article_id LEFT JOIN a0 ON a0.article_id = l.article_id "
    "LEFT JOIN a1 ON a1.article_id = l.article_id LEFT JOIN a2 ON a2.article_id = l.article_id LEFT JOIN fc ON fc.article_id = l.article_id "
    "LEFT JOIN cust ON cust.customer_id = l.customer_id LEFT JOIN c0 ON c0.customer_id = l.customer_id "
    "LEFT JOIN c1 ON c1.customer_id = l.customer_id LEFT JOIN c2 ON c2.customer_id = l.customer_id "
    "LEFT JOIN ph ON ph.customer_id = l.customer_id AND ph.article_id = l.article_id "
    + " ".join(f"LEFT JOIN (SELECT * FROM rates WHERE attribute = '{c}') q{i} ON q{i}.customer_id = l.customer_id AND q{i}.value = art.{c}"
               for i, c in enumerate(CATEGORIES)),
    "hist", "targ", "truth", "hist_wide", "fc", "art", "cust", cand=CAND, **_parts))
