"""Joins whose key may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which a few may hold a large share of ``big``.

    ``small`` holds one row per key. Where it is small by the size Spark
    measures it is broadcast and no row moves. Otherwise both sides are
    shuffled and adaptive execution splits the partitions of hot keys, and of
    ``small`` repeats only what meets them. It can split a partition only if
    the shuffle serves the join alone, which it does not where ``small`` is an
    aggregate by the same key; a hash of the key as one more join column
    gives the join shuffles of its own.
    """
    tagged = [side.withColumn("_key_hash", F.xxhash64(*[F.col(c).cast("string") for c in on])) for side in (big, small)]
    return tagged[0].join(tagged[1], [*on, "_key_hash"], how).drop("_key_hash")
