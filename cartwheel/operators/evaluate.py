"""Selecting the best twelve and measuring them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import running_sum, top_n
from cartwheel.functions.stage import cut

PAIR = ["customer_id", "article_id"]


# ---- selection ------------------------------------------------------------------------

def best_by_score(scored: DataFrame, score: str = "pred", n: int = 12, groups: Sequence[str] = (),
                  distinct: bool = True) -> DataFrame:
    """Top ``n`` articles per customer: best score per pair, ties to the smaller article id.

    Without ``distinct``, a pair proposed twice takes two places. Returns
    (groups, customer_id, article_id, score, rank), rank from 1.
    """
    if distinct:
        scored = scored.groupBy(*groups, *PAIR).agg(F.max(score).alias(score))
    return (top_n(scored, [*groups, "customer_id"], [F.desc(score), F.asc("article_id")], n)
            .select(*groups, *PAIR, score, "rank"))


def prediction_lists(ranked: DataFrame) -> DataFrame:
    """Ordered article array and its space-joined string per customer (at most n entries each)."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "article_id")))
    return (ranked.groupBy("customer_id").agg(entries.alias("_e"))
            .select("customer_id", F.transform("_e", lambda e: e["article_id"]).alias("article_ids"))
            .withColumn("prediction", F.array_join("article_ids", " ")))


def submission(sample: DataFrame, filled: DataFrame, n: int = 12) -> DataFrame:
    """Every sample customer with a prediction string, and whether it has ``n`` entries."""
    lists = prediction_lists(filled)
    return (sample.select("customer_id").distinct().join(lists, "customer_id", "left")
            .select("customer_id", "prediction", F.coalesce(F.size("article_ids"), F.lit(0)).alias("n_articles"))
            .withColumn("complete", F.col("n_articles") == n))


# ---- metrics --------------------------------------------------------------------------

def average_precision(ranked: DataFrame, truth: DataFrame, k: int = 12,
                      groups: Sequence[str] = ()) -> DataFrame:
    """AP@k per truth customer; a customer without predictions scores 0.

    ``groups`` keeps several rankings apart (strategies, weight vectors); then
    the result holds the customers each group ranked, with null for those
    outside the truth, and ``mean_average_precision`` counts absent ones as 0.
    """
    truth = truth.select(*PAIR).distinct()
    sizes = truth.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_true"))
    flagged = (ranked.filter(F.col("rank") <= k).select(*groups, *PAIR, "rank")
               .join(truth.withColumn("_hit", F.lit(1)), PAIR, "left"))
    # at most k rows per customer
    so_far = (Window.partitionBy(*groups, "customer_id").orderBy("rank")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    precision = F.when(F.col("_hit") == 1, F.count("_hit").over(so_far) / F.col("rank"))
    sums = (flagged.withColumn("_p", precision).groupBy(*groups, "customer_id")
            .agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias("_sum")))
    value = F.col("_sum") / F.least(F.col("n_true"), F.lit(k))
    if groups:
        return sums.join(sizes, "customer_id", "left").select(*groups, "customer_id", value.alias("ap"))
    return (sizes.join(sums, "customer_id", "left")
            .select("customer_id", F.coalesce(value, F.lit(0.0)).alias("ap")))


def mean_average_precision(ranked: DataFrame, truth: DataFrame, k: int = 12,
                           groups: Sequence[str] = ()) -> DataFrame:
    """MAP@k over the truth customers: one row, or one row per group."""
    ap = average_precision(ranked, truth, k, groups)
    if not groups:
        return ap.agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n_customers"))
    customers = truth.agg(F.count_distinct("customer_id")).scalar()
    total = ap.groupBy(*groups).agg(F.coalesce(F.sum("ap"), F.lit(0.0)).alias("_s"))
    return (total.withColumn("n_customers", customers)
            .select(*groups, (F.col("_s") / F.col("n_customers")).alias("map"), "n_customers"))


def coverage(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the truth pairs that were predicted; predictions may repeat pairs."""
    pairs = truth.select(*PAIR).distinct()
    flagged = pairs.join(predicted.select(*PAIR).distinct().withColumn("_hit", F.lit(1)), PAIR, "left")
    return (flagged.agg(F.count(F.lit(1)).alias("n_true"), F.count("_hit").alias("n_hits"))
            .withColumn("coverage", F.try_divide(F.col("n_hits"), F.col("n_true"))))


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of truth pairs among the candidates, each pair counted once."""
    return coverage(candidates, truth).withColumnRenamed("coverage", "recall")


def upper_bound_map(labelled: DataFrame, truth: DataFrame, k: int = 12) -> DataFrame:
    """MAP if the label itself were the score: the best a model could do on this set."""
    return mean_average_precision(best_by_score(labelled, "buy", k), truth, k)


def strategy_report(tagged: DataFrame, truth: DataFrame, k: int = 12,
                    strategy: str = "1st_stage_strategy", rank: str = "1st_stage_rank") -> DataFrame:
    """Per strategy in order: its own MAP, and the coverage of all strategies up to it."""
    ranked = tagged.withColumn("rank", F.col(rank) + 1)
    own = mean_average_precision(ranked, truth, k, [strategy])
    pairs = truth.select(*PAIR).distinct()
    total = pairs.agg(F.count(F.lit(1))).scalar()
    first = (tagged.groupBy(*PAIR).agg(F.min(strategy).alias(strategy))
             .join(pairs, PAIR, "left_semi").groupBy(strategy).agg(F.count(F.lit(1)).alias("_new")))
    # one row per strategy from here on
    running = Window.orderBy(strategy).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (own.join(first, strategy, "left").withColumn("_true", total)
            .withColumn("coverage", F.sum(F.coalesce("_new", F.lit(0))).over(running) / F.col("_true"))
            .select(strategy, "map", "coverage"))


def limit_grid(tagged: DataFrame, truth: DataFrame, grid: Sequence[Mapping[int, int]],
               strategy: str = "1st_stage_strategy", rank: str = "1st_stage_rank") -> DataFrame:
    """(grid_id, n_pairs, n_hits, recall) for each set of limits per strategy; strategies not named give nothing.

    Every set is judged in one job over the same tagged candidates: a row is in
    those sets whose limit for its strategy lies above its rank. For a pair the
    sets of all its rows are merged before anything is counted.
    """
    limits = F.create_map(*[x for s in sorted({s for g in grid for s in g}) for x in (
        F.lit(s), F.array(*[F.lit(g.get(s, 0)) for g in grid]))])
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(grid) - 1)),
                      lambda i: F.coalesce(F.get(F.try_element_at(limits, F.col(strategy)), i), F.lit(0)) > F.col(rank))
    pairs = truth.select(*PAIR).distinct().withColumn("_hit", F.lit(1))
    total = pairs.agg(F.count(F.lit(1))).scalar()
    found = (tagged.select(*PAIR, F.explode(inside).alias("grid_id")).distinct().join(pairs, PAIR, "left")
             .groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("_hit").alias("n_hits")))
    return found.withColumn("recall", F.try_divide(F.col("n_hits"), total))


def strategy_precision(tagged: DataFrame, target: DataFrame, k: int = 12, budget: int = 12,
                       strategy: str = "1st_stage_strategy", rank: str = "1st_stage_rank") -> DataFrame:
    """Precision of each strategy's first ``k`` per target customer, and the N it earns.

    N = int(precision / mean precision * budget).
    """
    pairs = target.select(*PAIR).distinct().withColumn("buy", F.lit(1))
    customers = target.select("customer_id").distinct()
    rated = (tagged.filter(F.col(rank) < k).join(customers, "customer_id", "left_semi")
             .join(pairs, PAIR, "left").groupBy(strategy)
             .agg(F.avg(F.coalesce("buy", F.lit(0))).alias("precision")))
    mean = rated.agg(F.avg("precision")).scalar()
    return (rated.withColumn("_mean", mean)
            .select(strategy, "precision",
                    F.floor(F.try_divide(F.col("precision"), F.col("_mean")) * budget + 1e-9).cast("int").alias("n")))


# ---- regression report ----------------------------------------------------------------

def average_ranks(frame: DataFrame, column: str) -> DataFrame:
    """(value, average rank) of the distinct non-null values, ties sharing their mean rank.

    Values are counted first; the distinct values are then spread over tasks by
    range, whatever their distribution.
    """
    counts = (frame.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    return running_sum(counts, ["value"], "c", "upto").select(
        "value", (F.col("upto") - (F.col("c") - 1) / 2).alias("avg_rank"))


def regression_report(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE, Pearson and Spearman correlation in one row."""
    rows = frame.select(F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).dropna()
    counted = rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("m"))
    ry = average_ranks(rows, "y").select(F.col("value").alias("y"), F.col("avg_rank").alias("ry"))
    rp = average_ranks(rows, "p").select(F.col("value").alias("p"), F.col("avg_rank").alias("rp"))
    ranked = skew_join(skew_join(counted, ry, ["y"], "inner"), rp, ["p"], "inner")
    # centred on the means, so that large values do not cancel
    ranked = cut(ranked)
    mean = lambda c: ranked.agg(F.sum(F.col("m") * F.col(c)) / F.sum("m")).scalar()
    ranked = ranked.withColumns({f"c{c}": F.col(c) - mean(c) for c in ("y", "p", "ry", "rp")})
    error = F.col("y") - F.col("p")
    return ranked.agg(
        F.sqrt(F.sum(F.col("m") * error * error) / F.sum("m")).alias("rmse"),
        (F.sum(F.col("m") * F.abs(error)) / F.sum("m")).alias("mae"),
        _weighted_corr("cy", "cp", "m").alias("pearson"),
        _weighted_corr("cry", "crp", "m").alias("spearman"))


def _weighted_corr(x: str, y: str, m: str) -> Column:
    x, y, m = F.col(x), F.col(y), F.col(m)
    n = F.sum(m)
    cov = F.sum(m * x * y) - F.sum(m * x) * F.sum(m * y) / n
    var = lambda v: F.sum(m * v * v) - F.sum(m * v) * F.sum(m * v) / n
    return F.try_divide(cov, F.sqrt(var(x)) * F.sqrt(var(y)))
