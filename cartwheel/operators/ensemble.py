"""Blending the rankings of several experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.ranks import top_n
from cartwheel.functions.stage import cut
from cartwheel.operators.evaluate import best_by_score, mean_average_precision

PAIR = ["customer_id", "article_id"]


def oof_ranks(oof: DataFrame, n: int = 12) -> DataFrame:
    """Top ``n`` per experiment and customer; the best entry gets the highest rank number."""
    keys = ["exp", "customer_id"]
    best = top_n(oof, keys, [F.desc("pred"), F.asc("article_id")], n, "_place")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return best.withColumn("rank", (size - F.col("_place") + 1).cast("int")).select(*PAIR, "exp", "rank")


def submission_ranks(submissions: DataFrame, n: int = 12) -> DataFrame:
    """Explode prediction strings: position i gets rank n - i."""
    entries = F.posexplode(F.slice(F.split("prediction", " "), 1, n))
    return (submissions.select("customer_id", "exp", entries.alias("_pos", "article_id"))
            .select(*PAIR, "exp", (F.lit(n) - F.col("_pos")).cast("int").alias("rank")))


def _weight(weights: Mapping[str, float]) -> Column:
    """Weight of the row's experiment as a literal map; other experiments weigh 0."""
    pairs = [part for name, w in weights.items() for part in (F.lit(name), F.lit(float(w)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("exp")), F.lit(0.0))


def last_weight(weights: Mapping[str, float], experiments: Sequence[str]) -> dict[str, float]:
    """Complete the weights: the last experiment gets 1 minus the sum of the others."""
    given = {e: weights[e] for e in experiments[:-1]}
    return given | {experiments[-1]: 1.0 - sum(given.values())}


def blend(ranks: DataFrame, weights: Mapping[str, float], rule: str = "max", n: int = 12) -> DataFrame:
    """Weighted ranks combined per pair by ``max`` or ``sum``; the best ``n`` per customer."""
    combine = {"max": F.max, "sum": F.sum}[rule]
    scored = (ranks.withColumn("_s", F.col("rank") * _weight(weights))
              .groupBy(*PAIR).agg(combine("_s").alias("score")))
    return best_by_score(scored, "score", n, distinct=False)


def evaluate_weights(ranks: DataFrame, truth: DataFrame, vectors: Sequence[Mapping[str, float]],
                     rule: str = "max", n: int = 12) -> DataFrame:
    """MAP of every weight vector in one job: (vector_id, map, n_customers).

    The vectors are given by the caller, so their table is as long as that
    list; each rank row meets the weights of its own experiment only.
    """
    combine = {"max": F.max, "sum": F.sum}[rule]
    spark = ranks.sparkSession
    rows = [(i, exp, float(w)) for i, v in enumerate(vectors) for exp, w in v.items()]
    table = spark.createDataFrame(rows, "vector_id int, exp string, w double")
    scored = (ranks.join(F.broadcast(table), "exp").groupBy("vector_id", *PAIR)
              .agg(combine(F.col("rank") * F.col("w")).alias("score")))
    ranked = best_by_score(scored, "score", n, ["vector_id"], distinct=False)
    return mean_average_precision(ranked, truth, n, ["vector_id"])


def best_weights(evaluated: DataFrame) -> DataFrame:
    """The vector with the highest MAP, ties to the smaller id."""
    return evaluated.orderBy(F.desc("map"), F.asc("vector_id")).limit(1)


def search_weights(ranks: DataFrame, truth: DataFrame, experiments: Sequence[str], rule: str = "max", n: int = 12, rounds: int = 20,
                   step: float = 0.25, tolerance: float = 1e-3) -> tuple[dict[str, float], float, int]:
    """(weights, their MAP, number of vectors tried) by a simplex search over the experiments' weights, which sum to 1.

    A round tries all points that the search may move to (reflection, expansion,
    both contractions and the shrunken simplex) in one job, and then moves as
    the plain method does. It ends when the simplex is smaller than
    ``tolerance`` or after ``rounds``. Equal MAPs go by the order of trial, so
    the same input gives the same weights.
    """
    ranks, truth = cut(ranks), cut(truth)
    size = len(experiments) - 1
    tried: dict[tuple[float, ...], tuple[float, int]] = {}

    def weights(point: Sequence[float]) -> tuple[float, ...]:
        own = [max(0.0, x) for x in point]
        own += [max(0.0, 1.0 - sum(own))]
        return tuple(round(w / sum(own), 9) for w in own)

    def evaluate(points: list[tuple[float, ...]]) -> list[tuple[float, int]]:
        new = list(dict.fromkeys(w for p in points if (w := weights(p)) not in tried))
        if new:
            report = evaluate_weights(ranks, truth, [dict(zip(experiments, w)) for w in new], rule, n)
            found = {r["vector_id"]: r["map"] for r in report.collect()}        # a row per vector
            for i, w in enumerate(new):
                tried[w] = (-found.get(i, 0.0), len(tried))
        return [tried[weights(p)] for p in points]

    even = [1.0 / (size + 1)] * size
    simplex = [tuple(even)] + [tuple(x + step * (i == j) for j, x in enumerate(even)) for i in range(size)]
    for _ in range(rounds if size else 0):
        simplex = [p for _, p in sorted(zip(evaluate(simplex), simplex))]
        best, worst = simplex[0], simplex[-1]
        if max(abs(a - b) for p in simplex[1:] for a, b in zip(p, best)) < tolerance:
            break
        center = [sum(p[i] for p in simplex[:-1]) / size for i in range(size)]
        along = lambda t: tuple(c + t * (c - w) for c, w in zip(center, worst))
        shrunken = [tuple((a + b) / 2 for a, b in zip(p, best)) for p in simplex[1:]]
        reflected, expanded, outer, inner = moves = [along(1.0), along(2.0), along(0.5), along(-0.5)]
        value = dict(zip([*moves, *simplex, *shrunken], (v for v, _ in evaluate([*moves, *simplex, *shrunken]))))
        if value[reflected] < value[best]:
            simplex[-1] = expanded if value[expanded] < value[reflected] else reflected
        elif value[reflected] < value[simplex[-2]]:
            simplex[-1] = reflected
        else:
            pulled = outer if value[reflected] < value[worst] else inner
            if value[pulled] < min(value[reflected], value[worst]):
                simplex[-1] = pulled
            else:
                simplex = [best, *shrunken]
    evaluate(simplex)
    found, (value, _) = min(tried.items(), key=lambda t: t[1])
    return dict(zip(experiments, found)), -value, len(tried)
