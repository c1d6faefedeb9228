"""Models: gradients, contracts and blends with SQL; fitted trees and factors have none."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cartwheel.functions.dates import trailing
from cartwheel.functions.stage import cut
from cartwheel.operators import candidates as C, ensemble as X, evaluate as E, factors as N, gradients as G, labels as L, limits as Y, models as M, prepare as P
from cartwheel.plans import blend as blend_plan, forecast as forecast_plan, two_stage as T
from checks import candidate_sql as Q
from checks.evaluation import _MAPS, _ranked_vectors, EXPERIMENTS, OOF, RANKS, SUB, VECTORS, candidates as simple_candidates, oof, submissions
from checks.features import CAND, LABELLED, _sampled, labelled
from checks.views import FORECAST_AFTER, GROUPS, TRAIN_START, VALID_END, VALID_START, Views, q6, r6, sql

QUERIES, SQL = {}, {}
FORECAST_UNTIL = "1995-09-01"


def add(name, fn):
    QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))


def _two_frames(v):
    """Training and validation week: candidates of the 22 strategies from the whole history, labelled, with all features."""
    tables = T.prepare(v.transactions, v.raw_customers, v.articles, v.forecast)
    split = P.Split(0, TRAIN_START, VALID_START)
    history, target = P.history_of(tables.transactions, split), P.target_of(tables.transactions, split)
    train = cut(T.labelled_frame(tables, history, target, groups=GROUPS))
    valid = cut(T.labelled_frame(tables, *P.holdout(tables.transactions, VALID_START, VALID_END), groups=GROUPS))
    return train, valid, P.feature_columns(train)


def buy_model_scores(v):
    """Two seeds with early stopping, averaged, best twelve kept."""
    train, valid, features = _two_frames(v)
    models = M.fit_seeds(train, valid, features, 2)
    return E.best_by_score(M.score_mean(models, valid, features))


def buy_model_map(v):
    train, valid, features = _two_frames(v)
    _, _, report = T.train_and_validate(train, valid, L.truth_pairs(v.target()), features, 1)
    return report


def bagged_model_scores(v):
    train, valid, features = _two_frames(v)
    bags = L.bagged_undersample(train, ["customer_id", "article_id", C.STRATEGY, C.RANK], 64.0, [0, 1])
    models = M.fit_bags(bags, None, features, [0, 1])
    return M.score_mean(models, valid, features)


def warm_cold_scores(v):
    """Customers with and without purchases before the week go to separate models."""
    train, valid, features = _two_frames(v)
    return M.score_warm_cold(M.fit_warm_cold(train, features), valid, features)


def model_importance(v):
    train, _, features = _two_frames(v)
    return M.importance(M.fit_seeds(train, None, features, 1))


def stored_model_scores(v):
    train, valid, features = _two_frames(v)
    folder = v.scratch("models")
    packed = M.pack_rows(train, None, features)
    for seed in (0, 1):
        M.save_model(M.fit_buy_model(train, None, features, seed, packed=packed), f"{folder}/buy-{seed}")
    return M.score_mean(M.find_models(v.spark, folder, "buy-"), valid, features)


def first_week_forecast(v):
    """Forecast by folds from the facts up to a day: articles sold later are the unseen ones."""
    history, _ = P.holdout(v.transactions, FORECAST_UNTIL)
    forecast, _ = forecast_plan.forecast_first_week(history, v.articles, FORECAST_AFTER, FORECAST_UNTIL)
    return forecast


def first_week_forecast_report(v):
    history, _ = P.holdout(v.transactions, FORECAST_UNTIL)
    _, report = forecast_plan.forecast_first_week(history, v.articles, FORECAST_AFTER, FORECAST_UNTIL, loss="squared")
    return report


def rolling_training_rows(v):
    tables = T.prepare(v.transactions, v.raw_customers, v.articles, v.forecast)
    splits = P.rolling_splits(TRAIN_START, VALID_START, 2)
    rows = T.rolling_training(tables, splits, per_week_groups=True, ratio=8.0, groups=GROUPS)
    return rows.groupBy("buy").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("n_groups"))


def _rolling_sql():
    """The relations of every week under names of their own, and the rows drawn from each."""
    ctes, drawn = {}, []
    for split in P.rolling_splits(TRAIN_START, VALID_START, 2):
        i = split.iter
        own = lambda text: re.sub(r"\b(hist_wide|hist|targ|truth|fc|cand|base|pairs|lab)\b", rf"\1_{i}", text)
        period = f"t_dat >= DATE '{split.hist_end}' AND t_dat < DATE '{split.target_end}'"
        ctes |= {
            f"hist_{i}": f"SELECT * FROM tx WHERE t_dat < DATE '{split.hist_end}'",
            f"hist_wide_{i}": f"SELECT * FROM wide WHERE t_dat < DATE '{split.hist_end}'",
            f"targ_{i}": f"SELECT * FROM tx WHERE {period}",
            f"truth_{i}": f"SELECT DISTINCT customer_id, article_id FROM tx WHERE {period}",
            f"fc_{i}": f"""SELECT * FROM fc WHERE "1st_week_sales_dat" BETWEEN (SELECT min(t_dat) FROM tx WHERE {period}) AND (SELECT max(t_dat) FROM tx WHERE {period})""",
            f"base_{i}": own(Q.tagged(C.DEFAULT_NS)), f"pairs_{i}": own(Q.SAME_DAY.format(rel="hist")),
            f"cand_{i}": f"SELECT * FROM base_{i} UNION ALL " + own(Q.expanded("base", "pairs", False)),
            f"lab_{i}": own(LABELLED)}
        drawn.append(f"SELECT buy, customer_id || '_{i}' AS customer_id FROM ({own(_sampled(8))})")
    return sql(f"SELECT buy, count(*) AS n, count(DISTINCT customer_id) AS n_groups FROM ({' UNION ALL '.join(drawn)}) GROUP BY buy",
               "tx", "wide", "fc", **ctes)


def final_submission(v):
    """Train on rolling weeks of the 22 strategies, stop early on the last week, recommend to every customer."""
    tables = T.prepare(v.transactions, v.raw_customers, v.articles, v.forecast)
    train = T.rolling_training(tables, P.rolling_splits(TRAIN_START, VALID_START, 2), ratio=8.0, groups=GROUPS)
    history, target = P.holdout(tables.transactions, VALID_START, VALID_END)
    valid = T.labelled_frame(tables, history, target, groups=GROUPS)
    features = P.feature_columns(train)
    models, _, _ = T.train_and_validate(train, valid, L.truth_pairs(target), features)
    return T.recommend_all(tables, v.raw_customers, models, features, "1995-06-01", groups=GROUPS)


def blended_submission(v):
    """Weights chosen on the holdout; lists are filled with the most bought articles."""
    popular = C.popular_article(v.history(), 12)
    _, result = blend_plan.choose_and_blend(oof(v), submissions(v), L.truth_pairs(v.target()), v.target(), VECTORS, "max", fallback=popular)
    return result


# ---- ranking losses, rounds and factors ------------------------------------------------

def _ranked_labels(v):
    """Labelled candidates with a score of a few values, so that ranks have ties."""
    return labelled(v).withColumn("score", 3.0 - F.floor(F.col(C.RANK) / 4))


def _gradients(metric):
    order = ("article_id", C.STRATEGY, C.RANK)
    return lambda v: G.add_ranking_gradients(_ranked_labels(v), "score", order=order, metric=metric).select(
        "customer_id", "article_id", C.STRATEGY, C.RANK, r6("gradient").alias("gradient"), r6("hessian").alias("hessian"))


# every pair of unlike labels with a row among the first twelve; what a swap changes, from the ranks and the hits up to each
_SWAP = {
    "ndcg": """abs(CASE WHEN u.k <= 12 THEN 1 / log2(u.k + 1.0::DOUBLE) ELSE 0 END - CASE WHEN d.k <= 12 THEN 1 / log2(d.k + 1.0::DOUBLE) ELSE 0 END)
        / (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM (SELECT unnest(range(1, 13)) AS i) WHERE i <= u.total)""",
    "map": """((u.hits + 1 - u.buy) / u.k::DOUBLE + (d.upto - CASE WHEN d.k <= 12 THEN d.buy / d.k::DOUBLE ELSE 0 END - u.upto)
        - CASE WHEN d.k <= 12 THEN d.hits / d.k::DOUBLE ELSE 0 END) / least(u.total, 12)"""}


def _gradient_sql(metric):
    row = '"1st_stage_strategy", "1st_stage_rank"'
    return sql(f"""SELECT customer_id, article_id, {row}, {q6('coalesce(gradient, 0)')} AS gradient, {q6('coalesce(hessian, 0)')} AS hessian
        FROM r LEFT JOIN (SELECT customer_id, k, sum(g) AS gradient, sum(h) AS hessian FROM (
            SELECT customer_id, unnest([uk, dk]) AS k, unnest([CASE WHEN ub = 1 THEN -w * doubt ELSE w * doubt END, CASE WHEN ub = 1 THEN w * doubt ELSE -w * doubt END]) AS g,
                   unnest([w * doubt * (1 - doubt), w * doubt * (1 - doubt)]) AS h
            FROM (SELECT u.customer_id, u.k AS uk, d.k AS dk, u.buy AS ub, {_SWAP[metric]} AS w,
                         1 / (1 + exp((u.score - d.score) * (2 * u.buy - 1))) AS doubt
                  FROM z u JOIN z d ON u.customer_id = d.customer_id AND u.k < d.k AND u.k <= 12 AND u.buy <> d.buy)) GROUP BY 1, 2) USING (customer_id, k)""",
        "hist", "targ", "truth", cand=CAND, lab=LABELLED,
        r=f"""SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id, {row}) AS k
            FROM (SELECT *, 3.0::DOUBLE - floor("1st_stage_rank" / 4) AS score FROM lab)""",
        y="SELECT *, CAST(sum(buy) OVER (PARTITION BY customer_id ORDER BY k) AS BIGINT) AS hits, CAST(sum(buy) OVER (PARTITION BY customer_id) AS BIGINT) AS total FROM r",
        z="SELECT *, sum(CASE WHEN k <= 12 THEN buy * 1.0::DOUBLE / k ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY k) AS upto FROM y")


for _metric in ("ndcg", "map"):
    add(f"ranking_gradients_{_metric}", _gradients(_metric))
    SQL[f"ranking_gradients_{_metric}"] = _gradient_sql(_metric)


def ranking_model_map(v):
    """MAP of the pointwise and both ranking losses, each stopped at its best round."""
    train, valid, features = _two_frames(v)
    truth, rows = L.truth_pairs(v.target()), []
    counts = truth.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_truth"))
    valid = cut(valid.join(counts, "customer_id", "left"))
    packed = M.pack_rows(train, valid, features, truth="n_truth")
    for objective in ("log_loss", "ndcg", "map"):
        model = M.fit_buy_model(train, valid, features, truth="n_truth", packed=packed, objective=objective, min_hessian=1e-6)
        value = E.mean_average_precision(E.best_by_score(M.score(model, valid), "pred"), truth).first()["map"]
        rows.append((objective, len(model.trees), len(model.history), float(value)))
    return v.spark.createDataFrame(rows, "objective string, rounds int, watched int, map double")


def booster_rounds(v):
    """Log loss and MAP on the holdout after each round."""
    train, valid, features = _two_frames(v)
    model = M.fit_buy_model(train, valid, features, rounds=10)
    return v.spark.createDataFrame(list(model.history), "rounds int, log_loss double, map double")


def factor_errors(v):
    """Squared error of the ranks 2 to 9, fitted in the same passes over the last year."""
    _, _, history = N.factorise(trailing(v.history(), "1y"), tuple(range(2, 10)), iterations=5)
    return v.spark.createDataFrame(history, "n_factors int, iteration int, error double")


def factor_counts(v):
    """Candidates per target: twelve different articles for everyone who bought before."""
    found = N.factor_candidates(v.history(), v.target(), iterations=3)
    return found.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("n_distinct"), F.max("1st_stage_rank").alias("last_rank"))


SQL["factor_counts"] = sql("SELECT DISTINCT customer_id, 12::BIGINT AS n, 12::BIGINT AS n_distinct, 11 AS last_rank FROM targ WHERE customer_id IN (SELECT customer_id FROM hist)",
                           "hist", "targ")


def factor_search_share(v):
    """Share of the pairs of buyers and articles that the bounded search scores."""
    rows, items, _ = N.factorise(trailing(v.history(), "1y"), (4,), iterations=3)
    best, share = N.best_products(rows, items)
    return best.agg(F.count_distinct("customer_id").alias("n_customers"), F.count(F.lit(1)).alias("n_found")).withColumn("share", F.lit(share))


def searched_weights(v):
    """Weights by simplex search on the holdout."""
    found, value, tried = X.search_weights(X.oof_ranks(oof(v)), L.truth_pairs(v.target()), list(EXPERIMENTS), "max", rounds=8)
    return v.spark.createDataFrame([(e, w, value, tried) for e, w in found.items()], "exp string, weight double, map double, tried int")


def searched_limits(v):
    """Limits per strategy that find most purchases within sixty candidates a customer."""
    found, pairs, hits, _ = Y.search_limits(simple_candidates(v), v.target(), list(range(8)), most=12)
    return v.spark.createDataFrame([(s, n, pairs, hits) for s, n in found.items()], "strategy int, n int, pairs long, hits long")


_BLENDED = f"""SELECT customer_id, string_agg(article_id, ' ' ORDER BY place) AS prediction, CAST(count(*) AS INTEGER) AS n_articles, count(*) = 12 AS complete
    FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY src, rank) AS place FROM (
      SELECT customer_id, article_id, src, rank FROM (
        SELECT customer_id, article_id, 0 AS src, rank FROM blended
        UNION ALL SELECT c.customer_id, article_id, 1, r FROM (SELECT DISTINCT customer_id FROM targ) c CROSS JOIN ({Q.popular()}))
      QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY src, rank) = 1) QUALIFY place <= 12) GROUP BY 1"""
_VECTOR_ROWS = ", ".join(f"({i}, '{e}', {w!r}::DOUBLE)" for i, vec in enumerate(VECTORS) for e, w in vec.items())
SQL["blended_submission"] = sql(
    _BLENDED, "hist", "targ", "truth", oof=OOF, ranks=RANKS, ranked=_ranked_vectors("max"), maps=_MAPS, sub=SUB,
    chosen=f"SELECT exp, w FROM (VALUES {_VECTOR_ROWS}) t(vector_id, exp, w) WHERE vector_id = (SELECT vector_id FROM maps ORDER BY map DESC, vector_id LIMIT 1)",
    blended="""SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank
        FROM (SELECT customer_id, article_id, max(rank * w) AS score FROM sub JOIN chosen USING (exp) GROUP BY 1, 2) QUALIFY rank <= 12""")

for _fn in (ranking_model_map, booster_rounds, factor_errors, factor_counts, factor_search_share, searched_weights, searched_limits):
    add(_fn.__name__, _fn)
for _fn in (buy_model_scores, buy_model_map, bagged_model_scores, warm_cold_scores, model_importance, stored_model_scores,
            first_week_forecast, first_week_forecast_report, rolling_training_rows, final_submission, blended_submission):
    add(_fn.__name__, _fn)
SQL["rolling_training_rows"] = _rolling_sql()
