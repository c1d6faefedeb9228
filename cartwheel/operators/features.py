"""Features of articles, customers and pairs, and their assembly onto candidates.

Transaction statistics are aggregates keyed by article, customer or pair, so
map tasks combine hot keys before the shuffle. Day differences are taken from
the last day of the rows aggregated: the whole history, or the week at hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.dates import last_day, last_day_value, week_bucket, window_start, with_last_day
from cartwheel.functions.joins import skew_join
from cartwheel.functions.stage import cut
from cartwheel.operators.prepare import members
from cartwheel.sources.schemas import ARTICLE_CATEGORIES, CUSTOMER_CATEGORIES

PAIR = ["customer_id", "article_id"]

# the optional blocks of the assembly
EXTRAS = ("channels", "trailing", "repeats", "buyer_rates", "candidate_age")

# fixed values: index groups whose purchase shares are customer features
INDEX_GROUPS = ["Ladieswear", "Divided", "Menswear", "Sport", "Baby/Children"]


def _week_suffix(week: int) -> str:
    return f"_{week + 1}weekago"


def _when(condition: Column | None, column: str) -> Column:
    return F.col(column) if condition is None else F.when(condition, F.col(column))


def bucket_ends(history: DataFrame, weeks: int, end: Column | str | None = None) -> Column:
    """Array with the last day found in each week bucket of the history (null for an empty week)."""
    rows = with_last_day(history, end)
    week = week_bucket(F.col("_end"))
    return _recent(rows, weeks).agg(F.array(*[F.max(F.when(week == i, F.col("t_dat"))) for i in range(weeks)])).scalar()


def _weekly_rows(history: DataFrame, weeks: int, end: Column | str | None, ends: Column | None = None) -> DataFrame:
    """Rows with their week bucket, the last day overall and the last day of each bucket."""
    ends = bucket_ends(history, weeks, end) if ends is None else ends
    return (with_last_day(history, end).withColumn("_week", week_bucket(F.col("_end")))
            .withColumn("_ends", ends))


def _recent(rows: DataFrame, weeks: int) -> DataFrame:
    return rows.filter(F.col("t_dat") > F.date_add("_end", -7 * weeks))


# ---- article side ---------------------------------------------------------------------

def article_attributes(articles: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = [c for c in (columns or ARTICLE_CATEGORIES) if c in articles.columns]
    return articles.select("article_id", *columns)


def _article_stats(condition: Column | None, end: Column, prefix: str, suffix: str) -> list[Column]:
    day, price, age = (_when(condition, c) for c in ("t_dat", "price", "age"))
    name = lambda text: f"{prefix}{text}{suffix}"
    end = F.max(end)
    return [
        F.nullif(F.count(day), F.lit(0)).alias(name("article_total_cnt")),
        F.datediff(end, F.max(day)).alias(name("article_total_latest_buy")),
        F.datediff(end, F.min(day)).alias(name("article_total_1st_buy")),
        F.max(price).alias(name("article_price_max")), F.min(price).alias(name("article_price_min")),
        F.avg(price).alias(name("article_price_mean")),
        F.max(age).alias(name("article_age_max")), F.min(age).alias(name("article_age_min")),
        F.avg(age).alias(name("article_age_mean")), F.stddev_samp(age).alias(name("article_age_std")),
    ]


def _weekly_article_stats(weeks: int) -> list[Column]:
    return [stat for i in range(weeks)
            for stat in _article_stats(F.col("_week") == i, F.col("_ends")[i], "", _week_suffix(i))]


def _age_medians(rows: DataFrame, weeks: int) -> DataFrame:
    """Median buyer age per article and week.

    Ages are counted per (article, week, age) first: the median then reads at
    most one row per distinct age, however many sales an article has.
    """
    ages = _recent(rows, weeks).groupBy("article_id", "_week", "age").agg(F.count(F.lit(1)).alias("c"))
    return ages.groupBy("article_id").agg(*[
        F.percentile(F.when(F.col("_week") == i, F.col("age")), F.lit(0.5), F.col("c"))
        .alias(f"article_age_median{_week_suffix(i)}") for i in range(weeks)])


def article_lifetime(history: DataFrame, end: Column | str | None = None) -> DataFrame:
    """Sales count, recency, price range and buyer ages over the whole history."""
    rows = with_last_day(history.filter(F.col("article_id").isNotNull()), end)
    return rows.groupBy("article_id").agg(*_article_stats(None, F.col("_end"), "", ""))


def article_weekly(history: DataFrame, weeks: int = 2, end: Column | str | None = None) -> DataFrame:
    """The same per week bucket, with the median buyer age."""
    rows = _weekly_rows(history.filter(F.col("article_id").isNotNull()), weeks, end)
    stats = _recent(rows, weeks).groupBy("article_id").agg(*_weekly_article_stats(weeks))
    return stats.join(_age_medians(rows, weeks), "article_id")


def article_statistics(history: DataFrame, weeks: int = 2, end: Column | str | None = None,
                       ends: Column | None = None) -> DataFrame:
    """Lifetime and weekly statistics from one aggregation over the facts."""
    rows = _weekly_rows(history.filter(F.col("article_id").isNotNull()), weeks, end, ends)
    stats = rows.groupBy("article_id").agg(*_article_stats(None, F.col("_end"), "", ""), *_weekly_article_stats(weeks))
    return stats.join(_age_medians(rows, weeks), "article_id", "left")


def article_by_channel(history: DataFrame, end: Column | str | None = None) -> DataFrame:
    """Lifetime statistics of online (2) and shop (1) sales side by side."""
    stats = []
    for prefix, channel in (("online_", 2), ("shop_", 1)):
        stats += _article_stats(F.col("sales_channel_id") == channel, F.col("_end"), prefix, "")
    return (with_last_day(history, end)
            .filter(F.col("article_id").isNotNull() & F.col("sales_channel_id").isin(1, 2))
            .groupBy("article_id").agg(*stats))


# ---- customer side --------------------------------------------------------------------

def customer_attributes(customers: DataFrame) -> DataFrame:
    return customers


def _customer_stats(condition: Column | None, end: Column, suffix: str, groups: Sequence[str],
                    channels: bool) -> list[Column]:
    day, price = _when(condition, "t_dat"), _when(condition, "price")
    end = F.max(end)
    stats = [
        F.nullif(F.count(day), F.lit(0)).alias(f"customer_total_cnt{suffix}"),
        F.datediff(end, F.max(day)).alias(f"customer_total_latest_buy{suffix}"),
        F.datediff(end, F.min(day)).alias(f"customer_total_1st_buy{suffix}"),
        F.max(price).alias(f"customer_price_max{suffix}"), F.min(price).alias(f"customer_price_min{suffix}"),
        F.avg(price).alias(f"customer_price_mean{suffix}"),
    ]

    def share(test: Column) -> Column:
        flag = F.when(test, 1).otherwise(0)
        return F.avg(flag if condition is None else F.when(condition, flag))

    stats += [share(F.col("index_group_name") == g).alias(f"{g}{suffix}") for g in groups]
    if channels:
        stats += [share(F.col("sales_channel_id") == 1).alias(f"shop{suffix}"),
                  share(F.col("sales_channel_id") == 2).alias(f"online{suffix}")]
    return stats


def _weekly_customer_stats(weeks: int, groups: Sequence[str]) -> list[Column]:
    return [stat for i in range(weeks)
            for stat in _customer_stats(F.col("_week") == i, F.col("_ends")[i], _week_suffix(i), groups, False)]


def customer_lifetime(history: DataFrame, groups: Sequence[str] = INDEX_GROUPS, channels: bool = False,
                      end: Column | str | None = None) -> DataFrame:
    """Purchase count, recency, prices and shares by index group (and by sales channel)."""
    rows = with_last_day(history.filter(F.col("customer_id").isNotNull()), end)
    return rows.groupBy("customer_id").agg(*_customer_stats(None, F.col("_end"), "", groups, channels))


def customer_weekly(history: DataFrame, weeks: int = 2, groups: Sequence[str] = INDEX_GROUPS,
                    end: Column | str | None = None) -> DataFrame:
    """The same per week bucket."""
    rows = _weekly_rows(history.filter(F.col("customer_id").isNotNull()), weeks, end)
    return _recent(rows, weeks).groupBy("customer_id").agg(*_weekly_customer_stats(weeks, groups))


def customer_statistics(history: DataFrame, weeks: int = 2, groups: Sequence[str] = INDEX_GROUPS,
                        end: Column | str | None = None, ends: Column | None = None, channels: bool = False) -> DataFrame:
    """Lifetime and weekly statistics from one aggregation over the facts.

    ``end`` and ``ends`` belong to the whole history; give them when
    ``history`` holds only some customers.
    """
    rows = _weekly_rows(history.filter(F.col("customer_id").isNotNull()), weeks, end, ends)
    return rows.groupBy("customer_id").agg(*_customer_stats(None, F.col("_end"), "", groups, channels),
                                           *_weekly_customer_stats(weeks, groups))


# ---- customer × article ---------------------------------------------------------------

def pair_totals(history: DataFrame) -> DataFrame:
    """Purchases, first and last day of every pair: the grain of pair features and rates."""
    return (history.filter(F.col("customer_id").isNotNull() & F.col("article_id").isNotNull())
            .groupBy(*PAIR).agg(F.count(F.lit(1)).alias("count"), F.min("t_dat").alias("_first"),
                                F.max("t_dat").alias("_last")))


def pair_history(pairs: DataFrame, history: DataFrame, end: Column | str | None = None) -> DataFrame:
    """Count and first / last purchase (days ago) of candidate pairs; each pair once."""
    bought = pair_totals(history).join(pairs.select(*PAIR), PAIR, "left_semi").withColumn("_end", last_day(history, end))
    return bought.select(*PAIR, "count", F.datediff("_end", "_first").alias("1st_buy_date_diff"),
                         F.datediff("_end", "_last").alias("latest_buy_date_diff"))


def pair_trailing_counts(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Purchases of candidate pairs in the last week, month and year; null if none.

    The windows end at the last day on which any candidate pair was bought.
    """
    bought = (history.groupBy(*PAIR, "t_dat").agg(F.count(F.lit(1)).alias("m"))
              .join(pairs.select(*PAIR), PAIR, "left_semi"))
    counts = [F.sum(F.when(F.col("t_dat") >= window_start(F.col("_end"), w), F.col("m"))).alias(name)
              for w, name in (("1w", "l1w_cnt"), ("1m", "l1m_cnt"), ("1y", "l1y_cnt"))]
    return with_last_day(bought).groupBy(*PAIR).agg(*counts)


def _rate_long(rows: DataFrame, key: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(key, attribute, value, rate): share of the key's purchases with the value, null values apart.

    Rows with the same values of a key are counted first, which takes a hot key
    apart, and kept as a table; rows with a ``weight`` are such counts already.
    One shuffle by key then serves the values, their totals and whatever groups
    by the key afterwards: a key has no more rows than its values have
    combinations.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"))
                        for c in columns])
    rows = rows.filter(F.col(key).isNotNull())
    if weight is None:
        rows = cut(rows.groupBy(key, *columns).agg(F.count(F.lit(1)).alias("m")))
    else:
        rows = rows.select(key, *columns, F.col(weight).alias("m"))
    counts = (rows.repartition(key).select(key, "m", F.explode(entries).alias("e"))
              .select(key, "m", "e.attribute", "e.value").filter(F.col("value").isNotNull())
              .groupBy(key, "attribute", "value").agg(F.sum("m").alias("c")))
    total = F.sum("c").over(Window.partitionBy(key, "attribute"))
    return counts.select(key, "attribute", "value", (F.col("c") / total).alias("rate"))


def same_article_type_rates(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of a customer's purchase share per attribute value."""
    return _rate_long(history, "customer_id", columns)


def same_customer_type_rates(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of an article's buyer share per customer attribute value."""
    return _rate_long(history, "article_id", columns)


def _rate_maps(rows: DataFrame, key: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per key with a value -> rate map per attribute.

    A map is as long as the category has values, so all attributes reach the
    candidates in one join instead of one join each.
    """
    long = _rate_long(rows, key, columns, weight)
    return long.groupBy(key).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("attribute") == c, F.struct("value", "rate"))))
        .alias(f"_rate_{c}") for c in columns])


def _look_up(frame: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    rates = {f"{c}{suffix}": F.try_element_at(f"_rate_{c}", F.col(c).cast("string")) for c in columns}
    return frame.withColumns(rates).drop(*[f"_rate_{c}" for c in columns])


def add_same_article_type_rates(frame: DataFrame, history: DataFrame,
                                columns: Sequence[str] = ARTICLE_CATEGORIES) -> DataFrame:
    """``{col}_customer_buy_rate``: share of the customer's purchases with the article's value, counted for the customers of ``frame``."""
    frame = cut(frame)          # read for its customers as well
    maps = _rate_maps(members(history, frame, "customer_id"), "customer_id", columns)
    return _look_up(frame.join(maps, "customer_id", "left"), columns, "_customer_buy_rate")


def add_same_customer_type_rates(frame: DataFrame, history: DataFrame,
                                 columns: Sequence[str] = CUSTOMER_CATEGORIES) -> DataFrame:
    """``{col}_article_buy_rate``: share of the article's buyers with the customer's value."""
    maps = _rate_maps(history, "article_id", columns)
    return _look_up(skew_join(frame, maps, ["article_id"]), columns, "_article_buy_rate")


def new_article_features(forecast: DataFrame) -> DataFrame:
    return forecast.select("article_id", F.lit(1).alias("new_article"), "1st_week_sales_pred")


def repeat_rate(history: DataFrame, key: str) -> DataFrame:
    """Share of a customer's or article's distinct purchase days that repeat an earlier pair.

    Of the distinct (day, customer, article) rows of a pair all but the first
    are repeats.
    """
    days = history.select("t_dat", *PAIR).distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("d"))
    return (days.filter(F.col(key).isNotNull()).groupBy(key)
            .agg((F.sum(F.col("d") - 1) / F.sum("d")).alias(f"{key.removesuffix('_id')}_repeat_rate")))


def candidate_age_of_articles(frame: DataFrame, column: str = "article_total_1st_buy") -> DataFrame:
    """Mean and median of an article feature over each customer's candidates, on every row."""
    value = F.coalesce(F.col(column), F.lit(0))
    mine = Window.partitionBy("customer_id")     # bounded: a customer has some hundred candidates
    return frame.withColumns({f"customer_{column}_mean": F.avg(value).over(mine),
                              f"customer_{column}_median": F.median(value).over(mine)})


# ---- first sales ----------------------------------------------------------------------

def first_sale(history: DataFrame) -> DataFrame:
    """Every row with its article's first sale date and the days since.

    The first dates are an aggregate joined back, not a window: a hot article
    is spread over tasks.
    """
    first = history.groupBy("article_id").agg(F.min("t_dat").alias("1st_tran_dat"))
    return (skew_join(history, first, ["article_id"])
            .withColumn("1st_tran_dat_diff", F.datediff("t_dat", "1st_tran_dat")))


def first_week_sales(history: DataFrame, first_after: str, days: int = 7) -> DataFrame:
    """Sales within ``days`` of the first sale, for articles first sold after a date.

    Daily counts per article come first, so the first date is found and used
    on a table of (article, day) size.
    """
    daily = (history.filter(F.col("article_id").isNotNull())
             .groupBy("article_id", "t_dat").agg(F.count(F.lit(1)).alias("m")))
    first = daily.groupBy("article_id").agg(F.min("t_dat").alias("1st_week_sales_dat"))
    return (daily.join(first.filter(F.col("1st_week_sales_dat") > F.lit(first_after).cast("date")), "article_id")
            .filter(F.datediff("t_dat", "1st_week_sales_dat") <= days)
            .groupBy("article_id", "1st_week_sales_dat").agg(F.sum("m").alias("1st_week_sales")))


# ---- assembly -------------------------------------------------------------------------

def add_features(candidates: DataFrame, transactions: DataFrame, articles: DataFrame, customers: DataFrame,
                 forecast: DataFrame, text_vectors: DataFrame | None = None, weeks: int = 2,
                 groups: Sequence[str] = INDEX_GROUPS, categories: Sequence[str] | None = None,
                 end: Column | str | None = None, extras: Sequence[str] = ()) -> DataFrame:
    """Join all features onto candidates.

    ``extras`` names optional blocks, all from the same one read of the facts:
    "channels" (statistics and shares by sales channel), "trailing" (pair counts
    of the last week, month and year), "repeats" (repeat rates of customers and
    articles), "buyer_rates" (shares of an article's buyers by customer
    attribute, for the candidates' articles) and "candidate_age" (mean and
    median age of a customer's candidates).

    ``transactions`` are the plain facts of the history; each aggregate joins
    only the customer or article columns it reads. Customer and pair features
    are computed for candidate customers only, and one table of pair totals
    serves both pair features and attribute rates. Everything known about an article
    is put into one table first, likewise for a customer: the candidates, by
    far the longest frame, meet three keys once each. Popular articles are
    candidates of every customer, hence the skew join on the article key.
    """
    categories = [c for c in (categories or ARTICLE_CATEGORIES) if c in articles.columns]
    end = last_day(transactions, last_day_value(transactions) if end is None else end)
    # one read of the facts and of their customers serves everything below
    aged = cut(skew_join(transactions, customers.select("customer_id", "age"), ["customer_id"]))
    ends = bucket_ends(aged, weeks, end)
    mine = members(aged, candidates, "customer_id")
    if unknown := set(extras) - set(EXTRAS):
        raise ValueError(f"unknown feature blocks: {sorted(unknown)}")
    grouped = skew_join(mine, articles.select("article_id", "index_group_name"), ["article_id"])
    totals = cut(pair_totals(mine))
    kinds = skew_join(totals.select(*PAIR, "count"), articles.select("article_id", *categories), ["article_id"])

    by_article = (article_attributes(articles, categories)
                  .join(article_statistics(aged, weeks, end, ends), "article_id", "left")
                  .join(new_article_features(forecast), "article_id", "left"))
    if text_vectors is not None:
        by_article = by_article.join(text_vectors, "article_id", "left")
    buyers = [c for c in CUSTOMER_CATEGORIES if c in customers.columns]
    if "channels" in extras:
        by_article = by_article.join(article_by_channel(aged, end), "article_id", "left")
    if "repeats" in extras:
        by_article = by_article.join(repeat_rate(aged, "article_id"), "article_id", "left")
    if "buyer_rates" in extras:
        wanted = members(aged.select(*PAIR), candidates, "article_id")
        described = skew_join(wanted, customers.select("customer_id", *buyers), ["customer_id"])
        by_article = by_article.join(_rate_maps(described, "article_id", buyers).withColumnsRenamed({f"_rate_{c}": f"_buyers_{c}" for c in buyers}), "article_id", "left")
    by_customer = (customer_attributes(customers)
                   .join(customer_statistics(grouped, weeks, groups, end, ends, "channels" in extras), "customer_id", "left")
                   .join(_rate_maps(kinds, "customer_id", categories, "count"), "customer_id", "left"))
    if "repeats" in extras:
        by_customer = by_customer.join(repeat_rate(mine, "customer_id"), "customer_id", "left")
    bought = totals.withColumn("_end", end).select(
        *PAIR, "count", F.datediff("_end", "_first").alias("1st_buy_date_diff"),
        F.datediff("_end", "_last").alias("latest_buy_date_diff"))
    wide = candidates.join(bought, PAIR, "left")
    wide = skew_join(wide, by_article, ["article_id"])
    wide = wide.join(by_customer, "customer_id", "left")
    wide = _look_up(wide, categories, "_customer_buy_rate")
    if "trailing" in extras:
        wide = wide.join(pair_trailing_counts(candidates.select(*PAIR).distinct(), mine), PAIR, "left")
    if "buyer_rates" in extras:
        wide = _look_up(wide.withColumnsRenamed({f"_buyers_{c}": f"_rate_{c}" for c in buyers}), buyers, "_article_buy_rate")
    return candidate_age_of_articles(wide) if "candidate_age" in extras else wide
