"""Selection, metrics, ensembles and profile counts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cartwheel.functions.dates import trailing
from cartwheel.operators import candidates as C, ensemble as B, evaluate as E, labels as L, profile as R
from cartwheel.plans.baseline import baseline_map, baseline_predictions
from checks import candidate_sql as Q
from checks.features import CAND, LABELLED, candidates, labelled, rounded
from checks.views import CATEGORIES, VALID_END, VALID_START, Views, q6, r6, since, sql

QUERIES, SQL = {}, {}


def add(name, fn, text=None):
    QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
    if text is not None:
        SQL[name] = text


# ---- the baseline, end to end ---------------------------------------------------------

BASE = f"""SELECT customer_id, article_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY src, r) AS INTEGER) AS rank FROM (
    SELECT customer_id, article_id, src, r FROM (
      SELECT customer_id, article_id, 0 AS src, r FROM ({Q.frequent()}) WHERE customer_id IN ({Q.TARGETS})
      UNION ALL SELECT customer_id, article_id, 1, r FROM ({Q.for_targets(Q.popular())}))
    QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY src, r) = 1) QUALIFY rank <= 12"""


def map_sql(ranked, group=None):
    """SQL of MAP@12 of a relation (customer_id, article_id, rank[, group])."""
    g, gc = (f"{group}, ", f"{group} AS ") if group else ("", "")
    hits = f"""SELECT {g}p.customer_id, CAST(row_number() OVER (PARTITION BY {g}p.customer_id ORDER BY rank) AS DOUBLE) / rank AS p
        FROM {ranked} p JOIN truth USING (customer_id, article_id) WHERE rank <= 12"""
    sums = f"SELECT {g}customer_id, sum(p) AS ps FROM ({hits}) GROUP BY ALL"
    sizes = "SELECT customer_id, least(count(*), 12) AS n FROM truth GROUP BY 1"
    if group:
        return f"""SELECT {group}, {q6('coalesce(sum(ps / n), 0) / (SELECT count(DISTINCT customer_id) FROM truth)')} AS map,
            (SELECT count(DISTINCT customer_id) FROM truth) AS n_customers
            FROM (SELECT DISTINCT {group} FROM {ranked}) LEFT JOIN (SELECT * FROM ({sums}) JOIN ({sizes}) USING (customer_id)) USING ({group}) GROUP BY 1"""
    return f"""SELECT {q6('avg(coalesce(ps, 0) / n)')} AS map, count(*) AS n_customers FROM ({sizes}) LEFT JOIN ({sums}) USING (customer_id)"""


add("baseline_map", lambda v: rounded(baseline_map(v.transactions, VALID_START, VALID_END), "map"),
    sql(map_sql("base"), "hist", "targ", "truth", base=BASE))
add("baseline_predictions", lambda v: baseline_predictions(v.history(), v.target()), sql("SELECT * FROM base", "hist", "targ", base=BASE))
add("average_precision", lambda v: rounded(E.average_precision(baseline_predictions(v.history(), v.target()), L.truth_pairs(v.target())), "ap"),
    sql(f"""SELECT customer_id, {q6('coalesce(s, 0) / n')} AS ap FROM (SELECT customer_id, least(count(*), 12) AS n FROM truth GROUP BY 1)
        LEFT JOIN (SELECT customer_id, sum(p) AS s FROM (SELECT p.customer_id,
          CAST(row_number() OVER (PARTITION BY p.customer_id ORDER BY rank) AS DOUBLE) / rank AS p FROM base p JOIN truth USING (customer_id, article_id))
          GROUP BY 1) USING (customer_id)""", "hist", "targ", "truth", base=BASE))

# ---- selection ------------------------------------------------------------------------


def scored(v):
    """A repeatable score: candidates of better ranks, from smaller strategies, come first."""
    return candidates(v).withColumn("pred", 1.0 / (1 + F.col(C.RANK) + F.col(C.STRATEGY) / 8))


SCORED = "SELECT customer_id, article_id, s, r, 1.0::DOUBLE / (1 + r + CAST(s AS DOUBLE) / 8) AS pred FROM cand"
BEST = """SELECT customer_id, article_id, pred, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) AS INTEGER) AS rank
    FROM (SELECT customer_id, article_id, max(pred) AS pred FROM scored GROUP BY 1, 2) QUALIFY rank <= 12"""
add("best_by_score", lambda v: E.best_by_score(scored(v)), sql(BEST, "hist", "targ", cand=CAND, scored=SCORED))
add("best_by_score_repeats", lambda v: E.best_by_score(scored(v), distinct=False),
    sql("""SELECT customer_id, article_id, pred, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) AS INTEGER) AS rank
        FROM scored QUALIFY rank <= 12""", "hist", "targ", cand=CAND, scored=SCORED))
add("prediction_lists", lambda v: E.prediction_lists(E.best_by_score(scored(v))),
    sql("""SELECT customer_id, list(article_id ORDER BY rank) AS article_ids, string_agg(article_id, ' ' ORDER BY rank) AS prediction
        FROM best GROUP BY 1""", "hist", "targ", cand=CAND, scored=SCORED, best=BEST))
add("submission", lambda v: E.submission(v.raw_customers, C.fill_to(
        E.best_by_score(scored(v)).withColumn(C.RANK, F.col("rank") - 1), C.popular_article(v.history()), v.raw_customers)),
    sql(f"""SELECT customer_id, string_agg(article_id, ' ' ORDER BY place) AS prediction, CAST(count(*) AS INTEGER) AS n_articles, count(*) = 12 AS complete
        FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY src, rank) AS place FROM (
          SELECT customer_id, article_id, src, rank FROM (
            SELECT customer_id, article_id, 0 AS src, rank FROM best
            UNION ALL SELECT c.customer_id, article_id, 1, r FROM raw_cust c CROSS JOIN ({Q.popular()}))
          QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY src, rank) = 1) QUALIFY place <= 12) GROUP BY 1""",
        "hist", "targ", "raw_cust", cand=CAND, scored=SCORED, best=BEST))

# ---- metrics --------------------------------------------------------------------------

add("coverage", lambda v: E.coverage(candidates(v), v.target()),
    sql("""SELECT count(*) AS n_true, count(c.article_id) AS n_hits, CAST(count(c.article_id) AS DOUBLE) / count(*) AS coverage
        FROM truth t LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM cand) c USING (customer_id, article_id)""", "hist", "targ", "truth", cand=CAND))
add("candidate_recall", lambda v: E.candidate_recall(candidates(v), v.target()),
    sql("""SELECT count(*) AS n_true, count(c.article_id) AS n_hits, CAST(count(c.article_id) AS DOUBLE) / count(*) AS recall
        FROM truth t LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM cand) c USING (customer_id, article_id)""", "hist", "targ", "truth", cand=CAND))
GRID = [{s: (3 + 5 * g + s) % 12 + 1 for s in range(8) if (s + g) % 5} for g in range(6)]
add("limit_grid", lambda v: E.limit_grid(candidates(v), v.target(), GRID),
    sql("""SELECT grid_id, count(*) AS n_pairs, count(t.customer_id) AS n_hits, CAST(count(t.customer_id) AS DOUBLE) / (SELECT count(*) FROM truth) AS recall
        FROM (SELECT DISTINCT customer_id, article_id, grid_id FROM cand JOIN grid USING (s) WHERE n > r) c LEFT JOIN truth t USING (customer_id, article_id) GROUP BY 1""",
        "hist", "targ", "truth", cand=CAND, grid="SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), {s}, {n})" for i, g in enumerate(GRID) for s, n in g.items()) + ") AS t(grid_id, s, n)"))
_UPPER = """SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY buy DESC, article_id) AS rank
    FROM (SELECT customer_id, article_id, max(buy) AS buy FROM lab GROUP BY 1, 2) QUALIFY rank <= 12"""
add("upper_bound_map", lambda v: rounded(E.upper_bound_map(labelled(v), v.target()), "map"),
    sql(map_sql("upper_bound"), "hist", "targ", "truth", cand=CAND, lab=LABELLED, upper_bound=_UPPER))
add("strategy_report", lambda v: rounded(E.strategy_report(candidates(v), v.target()), "map"),
    sql("""SELECT m.s AS "1st_stage_strategy", m.map,
          CAST((SELECT count(*) FROM truth t WHERE EXISTS (SELECT 1 FROM cand c WHERE c.customer_id = t.customer_id AND c.article_id = t.article_id AND c.s <= m.s)) AS DOUBLE)
          / (SELECT count(*) FROM truth) AS coverage FROM maps m""", "hist", "targ", "truth", cand=CAND,
        ranked="SELECT customer_id, article_id, s, r + 1 AS rank FROM cand", maps=map_sql("ranked", "s")))


def _forecast_pairs(v):
    """Actual first-week counts against lifetime daily sales: many ties on both sides."""
    sales = v.forecast.select("article_id", F.col("1st_week_sales_pred").alias("actual"))
    life = v.transactions.groupBy("article_id").agg((F.count(F.lit(1)) / 8).alias("predicted"))
    return life.join(sales, "article_id")


_PAIRS = """SELECT "1st_week_sales_pred" AS y, CAST(n AS DOUBLE) / 8 AS p FROM fc JOIN (SELECT article_id, count(*) AS n FROM tx GROUP BY 1) USING (article_id)"""
add("regression_report", lambda v: rounded(E.regression_report(_forecast_pairs(v), "actual", "predicted"), "rmse", "mae", "pearson", "spearman"),
    sql(f"""SELECT {q6('sqrt(avg((y - p) * (y - p)))')} AS rmse, {q6('avg(abs(y - p))')} AS mae, {q6('corr(y, p)')} AS pearson, {q6('corr(ry, rp)')} AS spearman
        FROM (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry,
              rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp FROM pairs)""", "tx", "fc", pairs=_PAIRS))
add("price_ranks", lambda v: E.average_ranks(v.transactions, "price"),
    sql("""SELECT DISTINCT price AS value, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS avg_rank FROM tx""", "tx"))

# ---- ensembles ------------------------------------------------------------------------

EXPERIMENTS = {"year": "1y", "month": "1m", "ever": "all"}


def oof(v):
    """Three experiments over the target customers, with purchase counts as predictions."""
    result = None
    for exp, window in EXPERIMENTS.items():
        part = C.customer_frequent(v.history(), 20, window).join(v.target().select("customer_id"), "customer_id", "left_semi")
        part = part.select("customer_id", "article_id", F.col("cnt").cast("double").alias("pred"), F.lit(exp).alias("exp"))
        result = part if result is None else result.unionByName(part)
    return result


OOF = " UNION ALL ".join(f"SELECT customer_id, article_id, CAST(cnt AS DOUBLE) AS pred, '{e}' AS exp FROM ({Q.frequent(w, 20)}) WHERE customer_id IN ({Q.TARGETS})"
                         for e, w in EXPERIMENTS.items())
RANKS = """SELECT customer_id, article_id, exp, CAST(count(*) OVER (PARTITION BY exp, customer_id) - place + 1 AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY exp, customer_id ORDER BY pred DESC, article_id) AS place FROM oof QUALIFY place <= 12)"""
WEIGHTS = {"year": 0.5, "month": 0.3}


def blend_sql(rule, weights, source="ranks"):
    case = " ".join(f"WHEN '{e}' THEN {w!r}::DOUBLE" for e, w in weights.items())
    return f"""SELECT customer_id, article_id, score, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS INTEGER) AS rank
        FROM (SELECT customer_id, article_id, {rule}(rank * (CASE exp {case} ELSE 0 END)) AS score FROM {source} GROUP BY 1, 2) QUALIFY rank <= 12"""


_ALL = B.last_weight(WEIGHTS, list(EXPERIMENTS))
add("oof_ranks", lambda v: B.oof_ranks(oof(v)), sql(RANKS, "hist", "targ", oof=OOF))


def submissions(v):
    """The experiments' predictions as submission strings."""
    ranked = B.oof_ranks(oof(v))
    result = None
    for exp in EXPERIMENTS:
        part = ranked.filter(F.col("exp") == exp).withColumn("rank", 13 - F.col("rank"))
        part = E.prediction_lists(part).select("customer_id", "prediction", F.lit(exp).alias("exp"))
        result = part if result is None else result.unionByName(part)
    return result


SUB = """SELECT customer_id, exp, article_id, CAST(12 - (row_number() OVER (PARTITION BY customer_id, exp ORDER BY rank DESC) - 1) AS INTEGER) AS rank FROM ranks"""
add("submission_ranks", lambda v: B.submission_ranks(submissions(v)), sql(SUB, "hist", "targ", oof=OOF, ranks=RANKS))
add("blend_max", lambda v: B.blend(B.oof_ranks(oof(v)), WEIGHTS, "max"), sql(blend_sql("max", WEIGHTS), "hist", "targ", oof=OOF, ranks=RANKS))
add("blend_sum", lambda v: rounded(B.blend(B.oof_ranks(oof(v)), {"year": 0.5, "month": 0.25, "ever": 0.25}, "sum"), "score"),
    sql(f"SELECT * REPLACE ({q6('score')} AS score) FROM ({blend_sql('sum', {'year': 0.5, 'month': 0.25, 'ever': 0.25})})", "hist", "targ", oof=OOF, ranks=RANKS))
VECTORS = [{"year": a / 4, "month": b / 4, "ever": 1 - a / 4 - b / 4} for a in range(5) for b in range(5 - a)]
_MAPS = map_sql("ranked", "vector_id")


def _ranked_vectors(rule):
    values = ", ".join(f"({i}, '{e}', {w!r}::DOUBLE)" for i, vec in enumerate(VECTORS) for e, w in vec.items())
    return f"""SELECT vector_id, customer_id, article_id, row_number() OVER (PARTITION BY vector_id, customer_id ORDER BY score DESC, article_id) AS rank
        FROM (SELECT vector_id, customer_id, article_id, {rule}(rank * w) AS score
              FROM ranks JOIN (SELECT * FROM (VALUES {values}) t(vector_id, exp, w)) USING (exp) GROUP BY 1, 2, 3) QUALIFY rank <= 12"""


for _rule in ("max", "sum"):
    add(f"weight_grid_{_rule}", lambda v, r=_rule: rounded(B.evaluate_weights(B.oof_ranks(oof(v)), L.truth_pairs(v.target()), VECTORS, r), "map"),
        sql(_MAPS, "hist", "targ", "truth", oof=OOF, ranks=RANKS, ranked=_ranked_vectors(_rule)))
add("best_weights", lambda v: rounded(B.best_weights(B.evaluate_weights(B.oof_ranks(oof(v)), L.truth_pairs(v.target()), VECTORS, "max")), "map"),
    sql(f"SELECT * FROM ({_MAPS}) ORDER BY map DESC, vector_id LIMIT 1", "hist", "targ", "truth", oof=OOF, ranks=RANKS, ranked=_ranked_vectors("max")))

# ---- profile --------------------------------------------------------------------------

add("status_counts_with_null", lambda v: R.value_counts(v.raw_customers, "FN", keep_null=True),
    sql('SELECT "FN" AS value, count(*) AS cnt FROM raw_cust GROUP BY 1', "raw_cust"))
add("postal_code_counts", lambda v: R.value_counts(v.raw_customers, "postal_code"),
    sql("SELECT postal_code AS value, count(*) AS cnt FROM raw_cust GROUP BY 1", "raw_cust"))
add("department_sales", lambda v: R.value_counts(v.wide_with(article_cols=["department_name"]), "department_name"),
    sql("SELECT department_name AS value, count(*) AS cnt FROM wide GROUP BY 1", "wide"))
_COLS = ["customer_id", "FN", "Active", "club_member_status", "fashion_news_frequency", "age", "postal_code"]
add("customer_column_profile", lambda v: R.column_profile(v.raw_customers, _COLS),
    sql(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count("{c}") AS BIGINT) AS n_null,
        count(DISTINCT "{c}") AS n_distinct FROM raw_cust""" for c in _COLS), "raw_cust"))
add("article_column_profile", lambda v: R.column_profile(v.articles, ["article_id", *CATEGORIES]),
    sql(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count("{c}") AS BIGINT) AS n_null,
        count(DISTINCT "{c}") AS n_distinct FROM art""" for c in ["article_id", *CATEGORIES]), "art"))
add("price_mode", lambda v: R.mode(v.transactions, "price", ["article_id"]),
    sql("""SELECT article_id, price AS mode FROM tx GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY count(*) DESC, price) = 1""", "tx"))
add("price_rate_to_mode", lambda v: R.rate_to_mode(v.transactions.select("article_id", "customer_id", "t_dat", "price"), "price", ["article_id"]),
    sql("""SELECT article_id, customer_id, t_dat, price, mode, price / mode AS price_rate FROM tx JOIN (
        SELECT article_id, price AS mode FROM tx GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY count(*) DESC, price) = 1) USING (article_id)""", "tx"))
add("daily_mean_price", lambda v: rounded(R.mean_by(v.transactions, ["article_id", "t_dat"], "price"), "_mean"),
    sql(f"SELECT article_id, t_dat, {q6('avg(price)')} AS price_mean FROM tx GROUP BY 1, 2", "tx"))


def _histogram_sql(rel, column):
    return f"""SELECT CAST(least(floor((x - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin, count(*) AS cnt FROM (
        SELECT CAST({column} AS DOUBLE) AS x, min(CAST({column} AS DOUBLE)) OVER () AS lo, max(CAST({column} AS DOUBLE)) OVER () AS hi FROM {rel} WHERE {column} IS NOT NULL) GROUP BY 1"""


add("price_histogram", lambda v: R.histogram(v.transactions, "price"), sql(_histogram_sql("tx", "price"), "tx"))
add("age_histogram", lambda v: R.histogram(v.raw_customers, "age"), sql(_histogram_sql("raw_cust", "age"), "raw_cust"))
add("customer_overlap", lambda v: R.overlap(trailing(v.transactions, "1y").select("customer_id"), v.raw_customers, "customer_id"),
    sql(f"""SELECT CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS n_both, CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS n_left_only,
        CAST(count(*) FILTER (WHERE b AND NOT a) AS BIGINT) AS n_right_only FROM (
        SELECT l.customer_id IS NOT NULL AS a, r.customer_id IS NOT NULL AS b FROM (SELECT DISTINCT customer_id FROM tx WHERE {since('1y', 'tx')}) l
        FULL JOIN (SELECT DISTINCT customer_id FROM raw_cust) r ON l.customer_id = r.customer_id)""", "tx", "raw_cust"))
add("customers_without_sales", lambda v: R.only_in(v.raw_customers, trailing(v.transactions, "1y"), "customer_id"),
    sql(f"SELECT customer_id FROM raw_cust EXCEPT SELECT customer_id FROM tx WHERE {since('1y', 'tx')}", "tx", "raw_cust"))
add("department_section_pairing", lambda v: R.pairing(v.articles, "department_name", "section_name"),
    sql("""SELECT 'department_name' AS side, department_name AS value, count(DISTINCT section_name) AS n_partners FROM art GROUP BY 2
        UNION ALL SELECT 'section_name', section_name, count(DISTINCT department_name) FROM art GROUP BY 2""", "art"))
add("names_with_digits", lambda v: R.matching(v.articles, "detail_desc", r"#1[0-9]\b").select("article_id", "detail_desc"),
    sql(r"SELECT article_id, detail_desc FROM art WHERE regexp_matches(detail_desc, '#1[0-9]\b')", "art"))
add("short_ids", lambda v: R.last_characters(v.articles.select("article_id", "prod_name"), "article_id", 6),
    sql("SELECT right('0' || article_id, 6) AS article_id, prod_name FROM art", "art"))
