"""Mixing sources to target weights by weighted fair queueing.

Every source lines its documents up in a shuffled order (a hash of seed and
id), as often as needed. A copy's virtual finish time is the number of its
source's words up to its end, divided by the source's target. All copies are
range-sorted by finish time, their words are added up over the ranges, and the
mix ends where the sum reaches the total budget, the sum of the targets in
whole words. The copy that the budget ends in is cut there (or, for whole
documents, taken when at least half of it lies before). So each source gets its
target up to a document or so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.functions.ranks import running_sum, sorted_rank
from cartwheel.functions.stage import cut
from cartwheel.llm.common import WORD_PATTERN, whole_text

WEIGHTS = (5, 2, 1)


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD_PATTERN)).cast("bigint")


def shuffle_key(seed: int, *columns: str) -> Column:
    """Sixteen hex digits that put rows into a repeatable random order."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 16)


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """Add ``target`` and ``place`` in the order to (source, source_size); one row per source, null allowed.

    Sources in code point order, null last, have ``weights`` in turn and share
    ``percent`` of all words; none gets more than ``most`` times its size, and
    what is over goes to the others by weight until none is above. Each round
    reads three sums from a table of one row per source.
    """
    ordered = sources.withColumn("_last", F.col("source").isNull())
    ranked = sorted_rank(ordered, ["_last", "source"], "_rank")
    by_turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = cut(ranked.withColumn("_weight", by_turn.cast("bigint")).drop("_last"))
    cap = F.col("source_size") * most
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, capped = None, -1
    while True:
        is_capped = F.lit(False) if share is None else F.lit(share[0]) * F.col("_weight") >= cap * F.lit(share[1])
        n, held, open_weight = weighed.agg(
            F.count(F.when(is_capped, 1)), F.coalesce(F.sum(F.when(is_capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_capped, F.col("_weight"))), F.lit(0))).first()
        if n == capped or not open_weight:
            break
        # words for each unit of weight, as a fraction of two whole numbers
        capped, share = n, (percent * total - 100 * held, 100 * open_weight)
    weighed = weighed.withColumnRenamed("_rank", "place")
    if share is None:
        return weighed.withColumn("target", F.lit(0.0)).drop("_weight")
    ratio = F.lit(float(share[0])) / F.lit(float(share[1]))
    return weighed.withColumn("target", F.least(ratio * F.col("_weight"), cap.cast("double"))).drop("_weight")


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2,
        whole: bool = False, size: Column | None = None, keep: Sequence[str] = (), numbered: bool = False) -> DataFrame:
    """The mix: (doc_id, source, size, source_size, target, pass, finish, words [, keep] [, row]).

    One row for every document and pass that is served before the budget ends,
    ``words`` of it taken: the whole document, less for the copy the budget ends
    in (with ``whole`` all or none). Documents of which nothing is taken appear
    once with ``words`` 0 and a null finish time, so that the result covers all
    rows. ``size`` defaults to the number of words in ``text``. Columns to
    ``keep`` meet the mix at its end, so that texts are not sorted. Ties go by
    key, id, source and size; rows of one id are lined up by all their columns,
    and equal rows are interchangeable. ``numbered`` adds ``row``, a number of
    the input row that its copies share and that may be another in the next run.
    Null sources are one source, null texts have size 0, null ids are kept.
    Empty table: empty mix.
    """
    size = word_count() if size is None else size
    content = F.xxhash64(*[F.col(c) for c in docs.columns if c not in ("doc_id", "source")]) if len(docs.columns) > 2 else F.lit(0).cast("bigint")
    rows = cut(docs.select("doc_id", "source", size.alias("size"), shuffle_key(seed, "doc_id").alias("_key"), content.alias("_content"), *keep,
                           F.monotonically_increasing_id().alias("_row")), "zstd")
    slim = rows.drop(*keep)
    sizes = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = cut(source_targets(sizes, weights, percent, most))
    # words of the sources before, from one row per source
    offsets = running_sum(targets.select("place", "source_size"), ["place"], "source_size", "_to").select(
        F.col("place").alias("_p"), (F.col("_to") - F.col("source_size")).alias("_before"))
    known = cut(targets.join(offsets, F.col("place") == F.col("_p")).withColumnRenamed("source", "_s").drop("_p"))
    lined = slim.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lined = running_sum(lined, ["place", "_key", "doc_id", "size", "_content", "_row"], "size", "_to")
    copies = lined.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(most)])))
    end = F.col("_to") - F.col("_before") + F.col("pass") * F.col("source_size")
    copies = copies.withColumn("finish", end / F.nullif(F.col("target"), F.lit(0.0)))
    # a copy's words, under a name of their own: ``size`` is part of the order
    queue = running_sum(copies.withColumn("words", F.col("size")), ["finish", "_key", "doc_id", "place", "size", "pass", "_content", "_row"], "words", "_served")
    budget = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).cast("bigint")).first()[0]
    left = F.lit(budget) - (F.col("_served") - F.col("size"))
    words = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), left))
    served = queue.withColumn("words", F.when(left > 0, words).otherwise(0).cast("bigint")).filter((F.col("words") > 0) | (F.col("pass") == 0))
    there = F.col("words") > 0
    mixed = served.select("doc_id", "source", "size", "source_size", "target", F.when(there, F.col("pass")).alias("pass"),
                          F.when(there, F.col("finish")).alias("finish"), "words", "_row")
    if keep:
        mixed = mixed.join(rows.select("_row", *keep), "_row")
    return mixed.withColumnRenamed("_row", "row") if numbered else mixed.drop("_row")


def words_taken(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of a mix, one row per input row.

    Without the ``row`` of a numbered mix, rows that share id, source and size cannot be told apart and are added up.
    """
    number = [c for c in ("row",) if c in mixed.columns]
    return (mixed.groupBy(*number, "doc_id", "source", "size", "source_size", "target")
            .agg(F.sum("words").alias("taken")).drop("source", *number))
