"""First-stage candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.operators import candidates as C, evaluate as E, models as M, pairs as B, prepare as P
from checks import candidate_sql as Q
from checks.preparation import _slice_sql
from checks.views import FORECAST_AFTER, VALID_START, Views, since, sql

QUERIES, SQL = {}, {}
WINDOWS = ("all", "1w", "1m", "1y")


def add(name, fn, text=None):
    QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
    if text is not None:
        SQL[name] = text


def as_rank(body, columns="customer_id, article_id"):
    return f'SELECT {columns}, r AS "1st_stage_rank" FROM ({body})'


def as_tagged(body):
    return f'SELECT customer_id, article_id, s AS "1st_stage_strategy", r AS "1st_stage_rank" FROM ({body})'


# ---- single strategies ----------------------------------------------------------------

for _w in WINDOWS:
    add(f"customer_frequent_{_w}", lambda v, w=_w: C.customer_frequent(v.history(), 12, w),
        sql(as_rank(Q.frequent(_w), "customer_id, article_id, cnt"), "hist"))
    add(f"popular_article_{_w}", lambda v, w=_w: C.popular_article(v.history(), 12, w),
        sql(as_rank(Q.popular(_w), "article_id, cnt"), "hist"))
    add(f"segment_frequent_{_w}",
        lambda v, w=_w: C.segment_frequent(v.history(v.wide_with(customer_cols=["customer_type"])), 12, w),
        sql(as_rank(Q.segment(_w)), "hist_wide"))
    add(f"favourite_department_{_w}",
        lambda v, w=_w: C.favourite_attribute_frequent(v.history(v.wide_with(article_cols=["department_name"])), "department_name", 12, w),
        sql(as_rank(Q.attribute("department_name", _w)), "hist_wide"))
    add(f"favourite_colour_{_w}",
        lambda v, w=_w: C.favourite_attribute_frequent(v.history(v.wide_with(article_cols=["perceived_colour_master_name"])), "perceived_colour_master_name", 12, w),
        sql(as_rank(Q.attribute("perceived_colour_master_name", _w)), "hist_wide"))

add("customer_frequent_recency", lambda v: C.customer_frequent(v.history(), 12, "all", recency_ties=True),
    sql(as_rank(Q.frequent(order="cnt DESC, latest DESC"), "customer_id, article_id, cnt"), "hist"))
add("customer_frequent_slice", lambda v: C.customer_frequent(v.history(), 12, "1y", length="1m"),
    sql(as_rank(Q.frequent(where=_slice_sql("1y", "1m", "hist")), "customer_id, article_id, cnt"), "hist"))
add("popular_article_slice", lambda v: C.popular_article(v.history(), 12, "1y", length="1w"),
    sql(as_rank(Q.popular(span=_slice_sql("1y", "1w", "hist")), "article_id, cnt"), "hist"))
add("popular_in_index_group",
    lambda v: C.popular_article(v.history(v.wide_with(article_cols=["index_group_name"])), 12, "1m", where=F.col("index_group_name") == "MEDIUM"),
    sql(as_rank(Q.popular("1m", rel="hist_wide", where="index_group_name = 'MEDIUM'"), "article_id, cnt"), "hist_wide"))
add("popular_new_article", lambda v: C.popular_new_article(v.forecast, 48),
    sql(as_rank(Q.newest(48), 'article_id, "1st_week_sales_pred"'), "fc"))


def _group_sql(group, expression):
    rows = f"SELECT tx.customer_id, article_id, {expression} AS g FROM tx LEFT JOIN cust10 USING (customer_id) WHERE t_dat < DATE '{VALID_START}'"
    return f"""SELECT customer_id, article_id, cnt, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY cnt DESC NULLS LAST, article_id) - 1 AS INTEGER) AS r
        FROM (SELECT DISTINCT customer_id, article_id, g FROM ({rows})) LEFT JOIN
             (SELECT article_id, g, count(*) AS cnt FROM ({rows}) WHERE g IS NOT NULL GROUP BY 1, 2) USING (article_id, g) QUALIFY r < 12"""


def _grouped(v, column):
    people = P.normalise_value(v.raw_customers, "fashion_news_frequency", "None", "NONE").withColumn("age_5inc", P.age_bin("age", 5))
    rows = P.denormalise(v.history(), people, v.articles, [column], [])
    return C.group_count_frequent(rows, column)


add("group_frequent_age", lambda v: _grouped(v, "age_5inc"),
    sql(as_rank(_group_sql("age_5inc", "CAST(floor(age / 5) * 5 AS INTEGER)"), "customer_id, article_id, cnt"), "tx", "cust10"))
add("group_frequent_news", lambda v: _grouped(v, "fashion_news_frequency"),
    sql(as_rank(_group_sql("news", "fashion_news_frequency"), "customer_id, article_id, cnt"), "tx", "cust10"))

add("bought_same_day", lambda v: B.bought_same_day(v.history()), sql(Q.SAME_DAY.format(rel="hist"), "hist"))
add("bought_same_day_big_baskets", lambda v: B.bought_same_day(v.history(), part_items=4),
    sql(Q.SAME_DAY.format(rel="hist"), "hist"))
add("bought_by_same_customer", lambda v: B.bought_by_same_customer(v.history(), "1w"),
    sql(Q.SAME_CUSTOMER.format(rel="hist", where=since("1w", "hist")), "hist"))
add("bought_by_same_customer_ever", lambda v: B.bought_by_same_customer(v.history(), "all"),
    sql(Q.SAME_CUSTOMER.format(rel="hist", where="TRUE"), "hist"))

add("popular_for_targets", lambda v: C.for_every_target(v.target(), C.popular_article(v.history(), 12, "1w")),
    sql(as_rank(Q.for_targets(Q.popular("1w"))), "hist", "targ"))
add("new_for_targets", lambda v: C.for_every_target(v.target(), C.popular_new_article(v.forecast, 48)),
    sql(as_rank(Q.for_targets(Q.newest(48))), "fc", "targ"))
add("tagged_strategy", lambda v: C.tag(C.customer_frequent(v.history(), 12, "1m"), 11),
    sql(as_tagged(f"SELECT customer_id, article_id, 11 AS s, r FROM ({Q.frequent('1m')})"), "hist"))

# ---- unions ---------------------------------------------------------------------------

_NS = C.DEFAULT_NS
_TUNED = {k: 4 + (7 * i) % 20 for i, k in enumerate(_NS)}


def _recommend(v, ns=None, partners=None, distinct=False, targets=None):
    return C.recommend(v.target() if targets is None else targets, v.history(), v.customers, v.articles, v.forecast, ns,
                       partners=partners, distinct_partners=distinct)


add("recommend_21_strategies", lambda v: _recommend(v), sql(as_tagged(Q.tagged(_NS)), "hist_wide", "targ", "fc"))
add("recommend_tuned_limits", lambda v: _recommend(v, _TUNED), sql(as_tagged(Q.tagged(_TUNED)), "hist_wide", "targ", "fc"))
add("recommend_with_partners", lambda v: _recommend(v, partners=B.bought_same_day(v.history())),
    sql(as_tagged(f"SELECT * FROM cand UNION ALL {Q.expanded('cand', 'pairs', False)}"), "hist_wide", "hist", "targ", "fc",
        cand=Q.tagged(_NS), pairs=Q.SAME_DAY.format(rel="hist")))


def _simple(v, windows=WINDOWS, n=12):
    return C.frequent_and_popular(v.history(), v.target(), n, windows)


add("frequent_and_popular", _simple, sql(as_tagged(Q.simple_tagged(WINDOWS)), "hist", "targ"))
add("frequent_and_popular_two_windows", lambda v: _simple(v, ("1w", "1m"), 20),
    sql(as_tagged(Q.simple_tagged(("1w", "1m"), 20)), "hist", "targ"))
add("partner_expansion",
    lambda v: C.expand_pairs(_simple(v), B.bought_by_same_customer(v.history(), "1w")),
    sql(as_tagged(Q.expanded("cand", "pairs")), "hist", "targ", cand=Q.simple_tagged(WINDOWS),
        pairs=Q.SAME_CUSTOMER.format(rel="hist", where=since("1w", "hist"))))
add("untagged_union", lambda v: C.untagged_union([_simple(v), C.expand_pairs(_simple(v), B.bought_by_same_customer(v.history(), "1w"))], v.target()),
    sql(f"SELECT customer_id, article_id FROM cand UNION SELECT customer_id, article_id FROM ({Q.expanded('cand', 'pairs')})",
        "hist", "targ", cand=Q.simple_tagged(WINDOWS), pairs=Q.SAME_CUSTOMER.format(rel="hist", where=since("1w", "hist"))))
add("wide_union", lambda v: C.wide_union(_simple(v), range(8)),
    sql("SELECT customer_id, article_id, " + ", ".join(f"min(CASE WHEN s = {s} THEN r END) AS rec{s}" for s in range(8))
        + " FROM cand GROUP BY 1, 2", "hist", "targ", cand=Q.simple_tagged(WINDOWS)))
add("sliced_candidates", lambda v: C.sliced_candidates(v.history(), v.target()),
    sql(" UNION ".join(
        f"SELECT customer_id, article_id FROM ({Q.frequent(where=_slice_sql(s, l, 'hist'))}) WHERE customer_id IN ({Q.TARGETS}) "
        f"UNION SELECT customer_id, article_id FROM ({Q.for_targets(Q.popular(span=_slice_sql(s, l, 'hist')))})"
        for s in WINDOWS for l in WINDOWS if s != "all" or l == "all"), "hist", "targ"))

# ---- variants -------------------------------------------------------------------------

add("fallback_fill", lambda v: C.fill_to(C.customer_frequent(v.history(), 12, "1m"), C.popular_article(v.history(), 12), v.customers),
    sql(f"""SELECT customer_id, article_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY src, r) AS INTEGER) AS rank FROM (
        SELECT customer_id, article_id, src, r FROM (
          SELECT customer_id, article_id, 0 AS src, r FROM ({Q.frequent('1m')}) WHERE customer_id IN (SELECT customer_id FROM cust10)
          UNION ALL SELECT customer_id, article_id, 1, r FROM cust10 CROSS JOIN ({Q.popular()}))
        QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY src, r) = 1) QUALIFY rank <= 12""", "hist", "cust10"))
add("candidates_with_actuals", lambda v: C.add_actuals(_simple(v), v.target()),
    sql("SELECT customer_id, article_id FROM cand UNION SELECT customer_id, article_id FROM targ", "hist", "targ", cand=Q.simple_tagged(WINDOWS)))


def _md5_rank(seed, columns):
    text = " || '|' || ".join([f"'{seed}'", *columns])
    return f"row_number() OVER (ORDER BY ('0x' || substr(md5({text}), 1, 8))::BIGINT, {', '.join(columns)})"


add("shuffled_negatives", lambda v: C.shuffled_negatives(v.transactions),
    sql(f"""SELECT DISTINCT customer_id, article_id FROM pairs UNION
        SELECT l.customer_id, r.article_id FROM (SELECT customer_id, {_md5_rank(42, ['customer_id', 'article_id'])} AS i FROM pairs) l
        JOIN (SELECT article_id, {_md5_rank(43, ['customer_id', 'article_id'])} AS i FROM pairs) r USING (i)""", "tx",
        pairs="SELECT DISTINCT customer_id, article_id FROM tx"))
add("strategy_precision", lambda v: E.strategy_precision(_recommend(v), v.target()),
    sql("""SELECT s AS "1st_stage_strategy", precision, CAST(floor(precision / avg(precision) OVER () * 12 + 1e-9::DOUBLE) AS INTEGER) AS n FROM (
        SELECT s, avg(CASE WHEN t.article_id IS NULL THEN 0 ELSE 1 END) AS precision
        FROM cand c LEFT JOIN truth t ON c.customer_id = t.customer_id AND c.article_id = t.article_id WHERE r < 12 GROUP BY 1)""",
        "hist_wide", "targ", "truth", "fc", cand=Q.tagged(_NS)))
add("factor_candidates", lambda v: M.factor_candidates(v.history(P.recent_facts(v.transactions, "2000-07-25")), v.target(), 12, rank=2))
