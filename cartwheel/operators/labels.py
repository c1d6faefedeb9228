"""Labels, negative sampling, folds and truth lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.ranks import md5_int, smallest_by_hash
from cartwheel.functions.stage import cut

PAIR = ["customer_id", "article_id"]


def add_labels(candidates: DataFrame, target: DataFrame) -> DataFrame:
    """``buy`` = 1 for pairs bought in the target period, else 0."""
    bought = target.select(*PAIR).distinct().withColumn("buy", F.lit(1))
    return candidates.join(bought, PAIR, "left").withColumn("buy", F.coalesce("buy", F.lit(0)))


def bagged_undersample(labelled: DataFrame, keys: Sequence[str], ratio: float = 1.0,
                       seeds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """All positives and int(positives * ratio) negatives, once per seed (column ``seed``).

    The negatives are exactly the first n in md5 order of (seed, keys). If
    there are fewer than n, all are kept.
    """
    labelled = cut(labelled)        # the count, the buckets and both sides of the draw read it
    each = F.explode(F.array(*[F.lit(s) for s in seeds]))
    positives = labelled.filter(F.col("buy") == 1).withColumn("seed", each)
    negatives = (labelled.filter(F.col("buy") == 0).withColumn("seed", each)
                 .withColumn("_h", md5_int(F.col("seed"), *keys)))
    wanted = labelled.agg(F.floor(F.coalesce(F.sum("buy"), F.lit(0)) * F.lit(ratio)).cast("long")).scalar()
    quota = (labelled.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
             .withColumn("n", wanted))
    drawn = smallest_by_hash(negatives, "seed", keys, "_h", quota).drop("_h")
    return positives.unionByName(drawn.select(*positives.columns))


def undersample(labelled: DataFrame, keys: Sequence[str], ratio: float = 1.0, seed: int = 42) -> DataFrame:
    return bagged_undersample(labelled, keys, ratio, [seed]).drop("seed")


def group_sizes(frame: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows per ranking group, in id order."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(key)


def assign_folds(frame: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return frame.withColumn("fold", F.pmod(md5_int(seed, key), F.lit(folds)).cast("int"))


def truth_pairs(target: DataFrame) -> DataFrame:
    """Distinct pairs of the target period; the form in which the metrics read the truth."""
    return target.select(*PAIR).distinct()


def truth_lists(target: DataFrame) -> DataFrame:
    """Sorted article list of each customer: one row per customer, as long as the customer bought articles.

    The metrics read ``truth_pairs``, which has no such row.
    """
    return truth_pairs(target).groupBy("customer_id").agg(F.array_sort(F.collect_list("article_id")).alias("article_ids"))
