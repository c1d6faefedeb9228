"""First-stage candidates: frequency strategies over trailing windows.

Every strategy returns (customer_id, article_id, 1st_stage_rank): the rank is
0-based inside the customer. Order is count descending, then article id, so
results do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.dates import in_slice, in_window, last_day_value, slice_grid, trailing, window_slice, with_last_day
from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import best_row, hash_rank, ordered_list, top_n
from cartwheel.functions.stage import cut
from cartwheel.operators.prepare import members

RANK = "1st_stage_rank"
STRATEGY = "1st_stage_strategy"
PAIR = ["customer_id", "article_id"]


def _known(history: DataFrame, *columns: str) -> DataFrame:
    """Grouping drops null keys: a null customer or article is nobody's purchase."""
    for c in columns:
        history = history.filter(F.col(c).isNotNull())
    return history


def _zero_based(frame: DataFrame) -> DataFrame:
    return frame.withColumn(RANK, (F.col("rank") - 1).cast("int")).drop("rank")


# ---- one strategy, one window ---------------------------------------------------------

def customer_frequent(history: DataFrame, n: int = 12, window: str = "all",
                      recency_ties: bool = False, length: str | None = None) -> DataFrame:
    """Each customer's most bought articles.

    ``recency_ties`` puts the later last purchase first among equal counts;
    ``length`` turns the trailing window into a bounded slice.
    """
    rows = window_slice(history, window, length) if length else trailing(history, window)
    aggs = [F.count(F.lit(1)).alias("cnt")]
    order = [F.desc("cnt")]
    if recency_ties:
        aggs.append(F.max("t_dat").alias("latest"))
        order.append(F.desc("latest"))
    counts = _known(rows, *PAIR).groupBy(*PAIR).agg(*aggs)
    best = top_n(counts, ["customer_id"], [*order, F.asc("article_id")], n)
    return _zero_based(best).select(*PAIR, "cnt", RANK)


def popular_article(history: DataFrame, n: int = 12, window: str = "all",
                    length: str | None = None, where: Column | None = None) -> DataFrame:
    """The globally most bought articles: (article_id, cnt, 1st_stage_rank), ``n`` rows.

    ``where`` limits the count to a sub-population such as one index group.
    """
    rows = window_slice(history, window, length) if length else trailing(history, window)
    if where is not None:
        rows = rows.filter(where)
    counts = _known(rows, "article_id").groupBy("article_id").agg(F.count(F.lit(1)).alias("cnt"))
    listed = ordered_list(counts.withColumn("_neg", -F.col("cnt")), n,
                          [F.col("_neg"), F.col("article_id")], ["article_id", "cnt"])
    return _zero_based(listed).select("article_id", "cnt", RANK)


def popular_new_article(forecast: DataFrame, n: int = 12) -> DataFrame:
    """Articles with the highest forecast first-week sales."""
    listed = ordered_list(forecast, n, [-F.col("1st_week_sales_pred"), F.col("article_id")],
                          ["article_id", "1st_week_sales_pred"])
    return _zero_based(listed).select("article_id", "1st_week_sales_pred", RANK)


def for_every_target(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """Give a short global list to every target customer.

    The list has at most its ``n`` entries; it enters as one array value and is
    exploded per customer, so targets are neither moved nor joined.
    """
    entries = listed.agg(F.array_sort(F.collect_list(F.struct(RANK, "article_id")))).scalar()
    return (targets.select("customer_id").distinct()
            .withColumn("_e", F.explode(entries))
            .select("customer_id", F.col("_e.article_id").alias("article_id"), F.col(f"_e.{RANK}").alias(RANK)))


def _top_lists(counts: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """One row per key with its top-n articles as a ranked array (at most n entries)."""
    best = top_n(counts, keys, [F.desc("cnt"), F.asc("article_id")], n)
    return (best.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "article_id"))).alias("_list")))


def _spread_lists(customers: DataFrame, lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach top lists by a key that many customers share, then explode."""
    joined = skew_join(customers, lists, keys, how="inner")
    return joined.withColumn("_e", F.explode("_list")).drop("_list")


def segment_frequent(history: DataFrame, n: int = 12, window: str = "all",
                     segment: str = "customer_type") -> DataFrame:
    """Top articles of a customer segment, for each of its customers active in the window."""
    rows = _known(trailing(history, window), *PAIR, segment)
    active = rows.select("customer_id", segment).distinct()
    counts = rows.groupBy(segment, "article_id").agg(F.count(F.lit(1)).alias("cnt"))
    spread = _spread_lists(active, _top_lists(counts, [segment], n), [segment])
    return spread.select("customer_id", F.col("_e.article_id").alias("article_id"),
                         (F.col("_e.rank") - 1).cast("int").alias(RANK))


def favourite_value(history: DataFrame, column: str) -> DataFrame:
    """Each customer's most bought value of ``column``; ties take the smallest value."""
    counts = (_known(history, "customer_id", column).groupBy("customer_id", column)
              .agg(F.count(F.lit(1)).alias("cnt")))
    return best_row(counts, ["customer_id"], [-F.col("cnt"), F.col(column)], [column])


def favourite_attribute_frequent(history: DataFrame, column: str, n: int = 12,
                                 window: str = "all") -> DataFrame:
    """Top articles of each customer's favourite attribute value."""
    rows = _known(trailing(history, window), *PAIR, column)
    counts = rows.groupBy(column, "article_id").agg(F.count(F.lit(1)).alias("cnt"))
    spread = _spread_lists(favourite_value(rows, column), _top_lists(counts, [column], n), [column])
    return spread.select("customer_id", F.col("_e.article_id").alias("article_id"),
                         (F.col("_e.rank") - 1).cast("int").alias(RANK))


def group_count_frequent(history: DataFrame, group: str, n: int = 12, window: str = "all") -> DataFrame:
    """A customer's own articles, ordered by how often the customer's group bought them.

    The group (age band, news frequency) is constant per customer. A null group
    has no count and its articles rank last.
    """
    rows = _known(trailing(history, window), *PAIR)
    own = rows.groupBy(*PAIR, group).agg(F.count(F.lit(1)).alias("_m"))
    counts = (own.filter(F.col(group).isNotNull()).groupBy("article_id", group)
              .agg(F.sum("_m").alias("cnt")))
    joined = skew_join(own.select(*PAIR, group), counts, ["article_id", group])
    best = top_n(joined, ["customer_id"], [F.desc_nulls_last("cnt"), F.asc("article_id")], n)
    return _zero_based(best).select(*PAIR, "cnt", RANK)


# ---- tagging and combining ------------------------------------------------------------

def tag(candidates: DataFrame, strategy: int) -> DataFrame:
    return candidates.select(*PAIR, F.lit(strategy).alias(STRATEGY), F.col(RANK))


def untagged_union(parts: Sequence[DataFrame], targets: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of all strategies, optionally for target customers only."""
    result = parts[0].select(*PAIR)
    for part in parts[1:]:
        result = result.unionByName(part.select(*PAIR))
    if targets is not None:
        result = result.join(targets.select("customer_id"), "customer_id", "left_semi")
    return result.distinct()


def wide_union(tagged: DataFrame, strategies: Sequence[int], prefix: str = "rec") -> DataFrame:
    """One row per pair with the rank under each strategy, null where it was not proposed.

    Equal to chained full outer joins of the strategies, in one aggregation.
    """
    return tagged.groupBy(*PAIR).agg(*[
        F.min(F.when(F.col(STRATEGY) == s, F.col(RANK))).alias(f"{prefix}{i}")
        for i, s in enumerate(strategies)])


def windowed_counts(history: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Rows per key in each named window, as columns cnt_<name>: one pass over the facts."""
    sums = [F.count(F.when(inside, 1)).alias(f"cnt_{name}") for name, inside in conditions.items()]
    return _known(history, *keys).groupBy(*keys).agg(*sums)


def sum_windows(counts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Window counts on a coarser key."""
    return counts.groupBy(*keys).agg(*[F.sum(f"`cnt_{w}`").alias(f"cnt_{w}") for w in names])


def by_window(counts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long form (keys, win, cnt); windows without rows drop out."""
    entries = F.array(*[F.struct(F.lit(w).alias("win"), F.col(f"`cnt_{w}`").alias("cnt")) for w in names])
    return (counts.select(*keys, F.explode(entries).alias("_e"))
            .select(*keys, "_e.win", "_e.cnt").filter(F.col("cnt") > 0))


def _window_lists(targets: DataFrame, popular: DataFrame) -> DataFrame:
    """(customer_id, win, article_id, rank): the short global list of every window for every target."""
    entries = popular.agg(F.collect_list(F.struct("win", "_list"))).scalar()
    everyone = (targets.withColumn("_w", F.explode(entries))
                .select("customer_id", F.col("_w.win").alias("win"), F.explode("_w._list").alias("_e")))
    return everyone.select("customer_id", "win", F.col("_e.article_id").alias("article_id"), F.col("_e.rank").alias("rank"))


def _own_and_popular(history: DataFrame, targets: DataFrame, n: int,
                     conditions: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Own and global best sellers in every window.

    Two passes over the facts, both with little to shuffle: the pairs of the
    target customers, and the article totals, which map tasks combine.
    """
    names = list(conditions)
    targets = targets.select("customer_id").distinct()
    own = by_window(windowed_counts(members(history, targets, "customer_id"), PAIR, conditions), PAIR, names)
    own = top_n(own, ["customer_id", "win"], [F.desc("cnt"), F.asc("article_id")], n)
    totals = by_window(windowed_counts(history, ["article_id"], conditions), ["article_id"], names)
    popular = _window_lists(targets, _top_lists(totals, ["win"], n))
    return own.select(*PAIR, "win", "rank"), popular.select(*PAIR, "win", "rank")


def frequent_and_popular(history: DataFrame, targets: DataFrame, n: int = 12,
                         windows: Sequence[str] = ("all", "1w", "1m", "1y"),
                         end: Column | str | None = None) -> DataFrame:
    """Own and global best sellers per window, tagged 0, 1, 2, … in window order.

    A subset of windows or another common ``n`` gives the smaller variants.
    """
    conditions = {w: in_window(F.col("_end"), w) for w in windows}
    own, popular = _own_and_popular(with_last_day(history, end), targets, n, conditions)
    place = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("win")).cast("int") - 1
    tagged = lambda frame, offset: frame.select(
        *PAIR, (place * 2 + offset).alias(STRATEGY), (F.col("rank") - 1).cast("int").alias(RANK))
    return tagged(own, 0).unionByName(tagged(popular, 1))


def sliced_candidates(history: DataFrame, targets: DataFrame, n: int = 12,
                      end: Column | str | None = None) -> DataFrame:
    """Own and global best sellers over the grid of start × length slices, distinct pairs."""
    conditions = {name: in_slice(F.col("_end"), s, l) for name, (s, l) in slice_grid().items()}
    return untagged_union(_own_and_popular(with_last_day(history, end), targets, n, conditions))


def add_actuals(candidates: DataFrame, actual: DataFrame) -> DataFrame:
    """Candidates plus the pairs really bought: the upper bound of any candidate set."""
    return candidates.select(*PAIR).unionByName(actual.select(*PAIR)).distinct()


def shuffled_negatives(actual: DataFrame, seed: int = 42) -> DataFrame:
    """True pairs, and the same customers with the articles permuted among the rows.

    Two md5 orders of the same rows are laid side by side: the customer of rank
    i in one gets the article of rank i in the other.
    """
    pairs = actual.select(*PAIR).distinct()
    left = hash_rank(pairs, PAIR, seed, "_i").select("customer_id", "_i")
    right = hash_rank(pairs, PAIR, seed + 1, "_i").select("article_id", "_i")
    return pairs.unionByName(left.join(right, "_i").select(*PAIR)).distinct()


def fill_to(own: DataFrame, popular: DataFrame, targets: DataFrame, n: int = 12) -> DataFrame:
    """Each target's own ranked articles, filled from the global list up to ``n``.

    Own entries come first; a global article already present is not repeated.
    Returns (customer_id, article_id, rank), rank from 1.
    """
    mine = (own.join(targets.select("customer_id").distinct(), "customer_id", "left_semi")
            .select(*PAIR, F.lit(0).alias("_src"), F.col(RANK).alias("_pos")))
    shared = for_every_target(targets, popular).select(*PAIR, F.lit(1).alias("_src"), F.col(RANK).alias("_pos"))
    merged = (mine.unionByName(shared).groupBy(*PAIR)
              .agg(F.min(F.struct("_src", "_pos")).alias("_k")))
    return top_n(merged, ["customer_id"], [F.asc("_k")], n).select(*PAIR, "rank")


# ---- the full set of strategies over four windows -------------------------------------

# fixed values: strategy keys in strategy order within one window
FAMILIES = ["cf", "ctf", "atfd", "atfp", "pa"]
# fixed values: default number of articles for each of the 20 strategy keys
DEFAULT_NS = {f"{f}_{w}": 12 for w in "awmy" for f in FAMILIES}
# fixed values: window key -> window name, and the number of its first strategy
WINDOW_KEYS = {"a": "all", "w": "1w", "m": "1m", "y": "1y"}
FIRST_STRATEGY = {"a": 0, "w": 6, "m": 11, "y": 16}
NEW_ARTICLE_STRATEGY = 5
PAIR_STRATEGY = 21


def _number(family: str) -> Column:
    """Strategy number of a family as a function of the window column."""
    expr = None
    for key, first in FIRST_STRATEGY.items():
        value = F.lit(first + FAMILIES.index(family))
        expr = F.when(F.col("win") == key, value) if expr is None else expr.when(F.col("win") == key, value)
    return expr


def _limit(family: str, ns: Mapping[str, int]) -> Column:
    expr = None
    for key in WINDOW_KEYS:
        value = F.lit(ns[f"{family}_{key}"])
        expr = F.when(F.col("win") == key, value) if expr is None else expr.when(F.col("win") == key, value)
    return expr


def _max_n(family: str, ns: Mapping[str, int]) -> int:
    return max(ns[f"{family}_{key}"] for key in WINDOW_KEYS)


def recommend(targets: DataFrame, history: DataFrame, customers: DataFrame, articles: DataFrame,
              forecast: DataFrame, ns: Mapping[str, int] | None = None, n_new: int = 48,
              partners: DataFrame | None = None, distinct_partners: bool = False,
              end: Column | str | None = None) -> DataFrame:
    """All 22 strategies for the target customers, tagged and ranked.

    ``customers`` holds customer_id and customer_type, ``articles`` article_id,
    department_name and perceived_colour_master_name. Without ``end`` a first
    read finds the last day, which then is a literal everywhere. One more read
    of the facts counts every pair in all windows; that table serves the
    targets' pairs, the articles and the (segment, article) counts.
    ``partners`` (article_id, partner_id) adds the bought-together strategy.
    """
    ns = dict(DEFAULT_NS, **(ns or {}))
    targets = cut(targets.select("customer_id").distinct())
    end = last_day_value(_known(history, *PAIR)) if end is None else end
    facts = with_last_day(_known(history, *PAIR).select(*PAIR, "t_dat"), end)
    conditions = {k: in_window(F.col("_end"), w) for k, w in WINDOW_KEYS.items()}
    names = list(conditions)
    all_pairs = cut(windowed_counts(facts, PAIR, conditions))
    pairs = cut(members(all_pairs, targets, "customer_id"))
    article_counts = cut(sum_windows(all_pairs, ["article_id"], names))
    parts = []

    def out(frame: DataFrame, family: str) -> None:
        parts.append(frame.filter(F.col("rank") <= _limit(family, ns))
                     .select(*PAIR, _number(family).alias(STRATEGY), (F.col("rank") - 1).cast("int").alias(RANK)))

    def total(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        return sum_windows(frame, keys, names)

    def long(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        return by_window(frame, keys, names)

    def lists(rows: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
        return _top_lists(rows, keys, _max_n(family, ns))

    def unfold(spread: DataFrame) -> DataFrame:
        return spread.select("customer_id", "win", F.col("_e.article_id").alias("article_id"),
                             F.col("_e.rank").alias("rank"))

    # own purchases
    out(top_n(long(pairs, PAIR), ["customer_id", "win"], [F.desc("cnt"), F.asc("article_id")], _max_n("cf", ns)), "cf")

    # customer segment
    types = customers.select("customer_id", "customer_type").filter(F.col("customer_type").isNotNull())
    typed = skew_join(all_pairs, types, ["customer_id"], "inner")
    segment_counts = cut(total(typed, ["customer_type", "article_id"]))         # all pairs are shuffled for it; those files go here
    segment_lists = lists(long(segment_counts, ["customer_type", "article_id"]), ["customer_type", "win"], "ctf")
    active = long(total(pairs, ["customer_id"]), ["customer_id"]).drop("cnt").join(types, "customer_id")
    out(unfold(_spread_lists(active, segment_lists, ["customer_type", "win"])), "ctf")

    # favourite attribute values
    for family, column in (("atfd", "department_name"), ("atfp", "perceived_colour_master_name")):
        values = articles.select("article_id", column).filter(F.col(column).isNotNull())
        value_lists = lists(long(article_counts.join(values, "article_id"), [column, "article_id"]), [column, "win"], family)
        mine = skew_join(pairs, values, ["article_id"], how="inner")
        tastes = long(total(mine, ["customer_id", column]), ["customer_id", column])
        favourite = best_row(tastes, ["customer_id", "win"], [-F.col("cnt"), F.col(column)], [column])
        out(unfold(_spread_lists(favourite, value_lists, [column, "win"])), family)

    # global best sellers and forecast newcomers: short lists for every target
    out(_window_lists(targets, lists(long(article_counts, ["article_id"]), ["win"], "pa")), "pa")
    newest = cut(popular_new_article(forecast, n_new))         # likewise what is behind a forecast
    parts.append(tag(for_every_target(targets, newest), NEW_ARTICLE_STRATEGY))

    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    if partners is not None:
        result = add_partners(result, partners, distinct=distinct_partners)
    return result


def add_partners(tagged: DataFrame, partners: DataFrame, distinct: bool = True) -> DataFrame:
    """Tagged candidates plus, for each, the article most often bought with it."""
    extra = expand_pairs(tagged, partners, distinct)
    return tagged.select(*PAIR, STRATEGY, RANK).unionByName(extra)


def expand_pairs(tagged: DataFrame, partners: DataFrame, distinct: bool = True) -> DataFrame:
    """The partner of every candidate article, as the bought-together strategy.

    Ranks follow the candidates' (strategy, rank) order. ``distinct`` keeps a
    partner once per customer, at its first place; otherwise one row remains
    for every candidate it was reached from.
    """
    mapped = skew_join(tagged, partners.select("article_id", "partner_id"), ["article_id"], how="inner").filter(F.col("partner_id").isNotNull())
    moved = mapped.select("customer_id", F.col("partner_id").alias("article_id"),
                          F.struct(STRATEGY, RANK, F.col("article_id").alias("via")).alias("_k"))
    if distinct:
        moved = moved.groupBy(*PAIR).agg(F.min("_k").alias("_k"))
    # a customer has a bounded number of candidates, so the window is short
    position = F.row_number().over(Window.partitionBy("customer_id").orderBy("_k")) - 1
    return moved.select(*PAIR, F.lit(PAIR_STRATEGY).alias(STRATEGY), position.cast("int").alias(RANK))
