"""Exploratory counts behind the data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import best_row


def value_counts(frame: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """(value, cnt) of a column, most frequent first."""
    rows = frame if keep_null else frame.filter(F.col(column).isNotNull())
    return (rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc_nulls_last("value")))


def _long(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return frame.select(F.explode(entries).alias("e")).select("e.column", "e.value")


def column_profile(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and distinct non-null values of each column.

    Counted per (column, value) first: an ordinary aggregation, where several
    exact distinct counts side by side would copy every row per column.
    """
    counts = _long(frame, columns or frame.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("column").agg(
        F.sum("c").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_distinct"))


def mode(frame: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, the smallest on ties, overall or per key."""
    counts = (frame.filter(F.col(column).isNotNull()).groupBy(*keys, column)
              .agg(F.count(F.lit(1)).alias("cnt")))
    return best_row(counts, keys, [-F.col("cnt"), F.col(column)], [column]).withColumnRenamed(column, "mode")


def rate_to_mode(frame: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Each row's value relative to the mode of its group (prices against the usual price)."""
    modes = mode(frame, column, keys)
    return (skew_join(frame, modes, keys)
            .withColumn(f"{column}_rate", F.try_divide(F.col(column), F.col("mode"))))


def mean_by(frame: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.avg(column).alias(f"{column}_mean"))


def histogram(frame: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, cnt) of equal-width bins between minimum and maximum; the last bin is closed."""
    rows = frame.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    lo, hi = rows.agg(F.min("x")).scalar(), rows.agg(F.max("x")).scalar()
    place = F.coalesce(F.floor(F.try_divide((F.col("x") - lo) * bins, hi - lo)), F.lit(0))
    return (rows.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables, only in the left, only in the right."""
    sides = (left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
             .groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")))
    return sides.agg(F.sum(F.col("l") * F.col("r")).alias("n_both"),
                     F.sum(F.col("l") * (1 - F.col("r"))).alias("n_left_only"),
                     F.sum(F.col("r") * (1 - F.col("l"))).alias("n_right_only"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def pairing(frame: DataFrame, left: str, right: str) -> DataFrame:
    """How many distinct partners each value of one column has in the other.

    All ones on both sides mean the two columns name the same thing.
    """
    pairs = frame.select(left, right).distinct()
    count = lambda c: pairs.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_partners"))
    return (count(left).withColumn("side", F.lit(left))
            .unionByName(count(right).withColumn("side", F.lit(right))).select("side", "value", "n_partners"))


def matching(frame: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text contains a regular expression."""
    return frame.filter(F.col(column).rlike(pattern))


def last_characters(frame: DataFrame, column: str, n: int = 10, pad: str = "0") -> DataFrame:
    """Ids as their last ``n`` characters after one leading pad character."""
    return frame.withColumn(column, F.right(F.concat(F.lit(pad), F.col(column)), F.lit(n)))
