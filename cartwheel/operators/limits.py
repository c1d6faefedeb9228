"""Search of the strategies' limits: how many candidates of each are worth their place.

What a limit vector gives is read off one compact table: for every pair the
smallest rank it has in each strategy, and whether it was bought. A pair is in
the candidate set of a vector if one of its ranks lies below that strategy's
limit, so many vectors are judged in one pass of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut, discard

PAIR = ["customer_id", "article_id"]
ABSENT = 1 << 30


def needed_ranks(tagged: DataFrame, truth: DataFrame, strategies: Sequence[int], strategy: str = "1st_stage_strategy",
                 rank: str = "1st_stage_rank") -> DataFrame:
    """(needs array<int>, hit): one row per pair, its smallest rank in each of the strategies."""
    needs = F.array(*[F.coalesce(F.min(F.when(F.col(strategy) == s, F.col(rank))), F.lit(ABSENT)).cast("int") for s in strategies])
    bought = truth.select(*PAIR).distinct().withColumn("hit", F.lit(True))
    return (tagged.filter(F.col(strategy).isin(list(strategies))).groupBy(*PAIR).agg(needs.alias("needs")).join(bought, PAIR, "left")
            .select("needs", F.coalesce("hit", F.lit(False)).alias("hit")))


def judge_limits(needs: DataFrame, vectors: np.ndarray) -> np.ndarray:
    """(pairs, hits) of every limit vector, in one job; a row per vector and task is added up by Spark."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(vectors), 2), np.int64)
        for batch in batches:
            ranks = batch.column("needs").flatten().to_numpy(zero_copy_only=False).reshape(-1, vectors.shape[1])
            hit = batch.column("hit").to_numpy(zero_copy_only=False)
            for i, limits in enumerate(vectors):
                inside = (ranks < limits).any(axis=1)
                total[i] += inside.sum(), (inside & hit).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vectors))), *[pa.array(c) for c in total.T]], ["vector", "pairs", "hits"])

    found = np.zeros((len(vectors), 2), np.int64)
    for r in needs.mapInArrow(emit, "vector bigint, pairs bigint, hits bigint").groupBy("vector").agg(F.sum("pairs").alias("p"), F.sum("hits").alias("h")).collect():
        found[r.vector] = r.p, r.h
    return found


def search_limits(tagged: DataFrame, truth: DataFrame, strategies: Sequence[int], most: int = 24, per_customer: float = 60.0, rounds: int = 5,
                  vectors: int = 40, seed: int = 42, strategy: str = "1st_stage_strategy",
                  rank: str = "1st_stage_rank") -> tuple[dict[int, int], int, int, list[tuple[int, int, int]]]:
    """(limits, pairs, hits, [(round, pairs, hits) of each round's best]) of the vector that finds most purchases.

    Vectors with more than ``per_customer`` pairs a customer of ``tagged`` do
    not compete, unless none is within. Each round draws vectors of limits from
    0 to ``most`` around the best quarter of all so far, first evenly; equal
    finds go to fewer pairs and then to the earlier vector. The draws are
    repeatable. Every round is one job over the compact table.
    """
    needs = cut(needed_ranks(tagged, truth, strategies, strategy, rank))
    customers = tagged.select("customer_id").distinct().count()
    rng = np.random.default_rng(seed)
    tried, results, history = np.zeros((0, len(strategies)), np.int64), np.zeros((0, 2), np.int64), []

    def order() -> np.ndarray:
        over = results[:, 0] > per_customer * customers
        return np.lexsort((np.arange(len(results)), results[:, 0], np.where(over, 0, -results[:, 1]), over))

    for round_ in range(rounds):
        if round_:
            elite = tried[order()[:max(2, len(tried) // 4)]]
            drawn = rng.normal(elite.mean(axis=0), elite.std(axis=0) + 1, (vectors, len(strategies)))
        else:
            drawn = rng.uniform(0, most + 1, (vectors, len(strategies)))
        fresh = np.clip(np.floor(drawn), 0, most).astype(np.int64)
        tried, results = np.concatenate([tried, fresh]), np.concatenate([results, judge_limits(needs, fresh)])
        best = order()[0]
        history.append((round_, *results[best].tolist()))
    discard(needs)
    best = order()[0]
    return dict(zip(strategies, tried[best].tolist())), *results[best].tolist(), history
