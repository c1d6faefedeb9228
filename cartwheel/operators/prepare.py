"""Preparation of customers, articles and transactions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import hash_rank, sorted_rank
from cartwheel.functions.stage import cut
from cartwheel.sources.schemas import MODEL_CATEGORIES


# ---- ids, values and bins -------------------------------------------------------------

def surrogate_ids(frame: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """(value, dense 0-based integer) for the distinct values of ``column``.

    Numbered in md5 order, because that order splits over tasks evenly. Only
    matrix work needs integers; everything else keeps the string ids.
    """
    values = frame.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = hash_rank(values, [column], seed, f"{column}_idx")
    return ranked.withColumn(f"{column}_idx", F.col(f"{column}_idx") - 1)


def normalise_value(frame: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return frame.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def age_bin(age: Column | str, width: int) -> Column:
    """Lower edge of the age bin; null age stays null."""
    column = F.col(age) if isinstance(age, str) else age
    return (F.floor(column / width) * width).cast("int")


def label_codes(frame: DataFrame, columns: Sequence[str], large: bool = False) -> DataFrame:
    """Dictionary (column, value, code): sorted distinct values -> 0..k-1, null as ''.

    All columns are read in one pass. A window sorts each column's distinct
    category values, never rows; ``large`` numbers them over many tasks, for
    columns whose dictionary itself grows with the data.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
                      for c in columns])
    values = frame.select(F.explode(pairs).alias("p")).select("p.column", "p.value").distinct()
    if not large:
        order = Window.partitionBy("column").orderBy("value")
        return values.withColumn("code", F.row_number().over(order) - 1)
    ranked = sorted_rank(values, ["column", "value"], "_r")
    first = ranked.groupBy("column").agg(F.min("_r").alias("_first"))      # one row per column name
    return (ranked.join(F.broadcast(first), "column")
            .select("column", "value", (F.col("_r") - F.col("_first")).cast("int").alias("code")))


def label_encode(frame: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace category values by their codes; one dictionary join per column.

    ``codes`` may come from another frame (fit once, use twice).
    """
    codes = cut(label_codes(frame, columns)) if codes is None else codes       # every column's join reads it
    names = frame.columns
    for c in columns:
        side = codes.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        valued = frame.withColumn("_value", F.coalesce(F.col(c).cast("string"), F.lit("")))
        frame = (skew_join(valued, side, ["_value"]).drop("_value", c)
                 .withColumnRenamed("_code", c))
    return frame.select(*names)


def enum_flag(column: str, name: str) -> Column:
    """1 where a category equals a named value: names are compared, not codes."""
    return F.when(F.col(column) == name, 1).otherwise(0)


def customer_segment(customers: DataFrame) -> DataFrame:
    """Add ``age10``, the segment text and its code ``customer_type``.

    The text joins flags, status, news frequency and age decade with nulls as
    0; statuses enter by their codes, as the flags do.
    """
    base = customers.withColumn("age10", age_bin("age", 10))
    coded = ["club_member_status", "fashion_news_frequency", "age10"]
    copies = [f"_code_{c}" for c in coded]
    work = base.select("*", *[F.col(c).alias(k) for c, k in zip(coded, copies)])
    work = label_encode(work, copies)
    flags = [F.coalesce(F.col(c), F.lit(0.0)).cast("int").cast("string") for c in ("FN", "Active")]
    segment = F.concat(*flags, *[F.col(k).cast("string") for k in copies])
    work = work.select(*base.columns, segment.alias("segment"), segment.alias("customer_type"))
    return label_encode(work, ["customer_type"])


def denormalise(transactions: DataFrame, customers: DataFrame, articles: DataFrame,
                customer_cols: Sequence[str] | None = None,
                article_cols: Sequence[str] | None = None) -> DataFrame:
    """Transactions with customer and article columns; unmatched keys keep nulls.

    Either key may be hot, so both joins may split it. A dimension that is small
    by the size Spark knows is broadcast and no rows move; one without a wanted
    column is not joined.
    """
    wide = transactions
    for side, key, wanted in ((customers, "customer_id", customer_cols), (articles, "article_id", article_cols)):
        if wanted is None or len(wanted):               # without a column the join would change nothing
            wide = skew_join(wide, side if wanted is None else side.select(key, *wanted), [key])
    return wide


# ---- row filters ----------------------------------------------------------------------

def recent_facts(transactions: DataFrame, after: str) -> DataFrame:
    return transactions.filter(F.col("t_dat") > F.lit(after).cast("date"))


def members(frame: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``; facts may sit on one key."""
    return skew_join(frame, ids.select(key).distinct(), [key], "left_semi")


def non_members(frame: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key never occurs in ``ids`` (articles that were never sold)."""
    return frame.join(ids.select(key).distinct(), key, "left_anti")


def warm_cold(frame: DataFrame, probe: str = "customer_total_cnt") -> tuple[DataFrame, DataFrame]:
    """Rows with and without history."""
    return frame.filter(F.col(probe).isNotNull()), frame.filter(F.col(probe).isNull())


def equal_to(frame: DataFrame, column: str, value) -> DataFrame:
    return frame.filter(F.col(column) == value)


def forecast_in_period(forecast: DataFrame, target: DataFrame) -> DataFrame:
    """Forecast rows dated inside the target period, both ends included."""
    first = target.agg(F.min("t_dat")).scalar()
    last = target.agg(F.max("t_dat")).scalar()
    return forecast.filter(F.col("1st_week_sales_dat").between(first, last))


def forecast_from(forecast: DataFrame, first_day: str) -> DataFrame:
    return forecast.filter(F.col("1st_week_sales_dat") >= F.lit(first_day).cast("date"))


# ---- time splits ----------------------------------------------------------------------

class Split(NamedTuple):
    iter: int
    hist_end: str       # history: t_dat < hist_end
    target_end: str     # target: hist_end <= t_dat < target_end


def rolling_splits(hist_end: str, target_end: str, n_iter: int, step_days: int = 8) -> list[Split]:
    """Split dates of the rolling training weeks, latest first.

    Each step goes 7 days back from the last day *inside* the period, which is
    one day before its open end: 8 days when every day has sales.
    """
    day = dt.date.fromisoformat
    back = lambda text, i: (day(text) - dt.timedelta(days=step_days * i)).isoformat()
    return [Split(i, back(hist_end, i), back(target_end, i)) for i in range(n_iter)]


def history_of(transactions: DataFrame, split: Split) -> DataFrame:
    return transactions.filter(F.col("t_dat") < F.lit(split.hist_end).cast("date"))


def target_of(transactions: DataFrame, split: Split) -> DataFrame:
    return transactions.filter((F.col("t_dat") >= F.lit(split.hist_end).cast("date"))
                               & (F.col("t_dat") < F.lit(split.target_end).cast("date")))


def tag_splits(transactions: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Each row once per split it belongs to, with ``iter`` and ``part``.

    A row belongs to the history of many splits, so the split table is attached
    as an array that is filtered per row: no join, no shuffle.
    """
    table = F.array(*[F.struct(F.lit(s.iter).alias("iter"),
                               F.lit(s.hist_end).cast("date").alias("hist_end"),
                               F.lit(s.target_end).cast("date").alias("target_end"))
                      for s in splits])
    mine = F.filter(table, lambda s: F.col("t_dat") < s["target_end"])
    tagged = transactions.withColumn("_s", F.explode(mine))
    part = F.when(F.col("t_dat") < F.col("_s.hist_end"), "history").otherwise("target")
    return tagged.withColumn("iter", F.col("_s.iter")).withColumn("part", part).drop("_s")


def holdout(transactions: DataFrame, start: str, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(history before ``start``, target from ``start`` on, up to and including ``end``)."""
    first = F.lit(start).cast("date")
    target = transactions.filter(F.col("t_dat") >= first)
    if end is not None:
        target = target.filter(F.col("t_dat") <= F.lit(end).cast("date"))
    return transactions.filter(F.col("t_dat") < first), target


def iteration_id(frame: DataFrame, iteration: int) -> DataFrame:
    """Customer ids made unique per rolling week, so that weeks stay apart as ranking groups."""
    return frame.withColumn("customer_id", F.concat_ws("_", F.col("customer_id"), F.lit(str(iteration))))


def feature_columns(frame: DataFrame, exclude: Sequence[str] = ("customer_id", "article_id", "buy"),
                    categories: Sequence[str] = MODEL_CATEGORIES) -> list[str]:
    """Numbers, dates excluded, and the text columns that are named as categories.

    Other text (postal codes and the like) is close to an id; it can enter as its label code, a number.
    """
    kinds = dict(frame.dtypes)
    return [c for c in frame.columns if c not in exclude and (c in categories or kinds[c] not in ("string", "date"))]
