"""The article most often bought together with each article.

Both forms are one problem: baskets hold items with a left and a right weight,
score(a, b) = sum over baskets of left(a) * right(b), and the best b is kept
per a. Repeated purchases are folded into the weights first.

A basket's items are dealt by hash into parts of about ``part_items``, and a
part of the left items meets a part of the right ones. So a basket of any size
is many tasks' work. Pairs themselves are never shuffled: a task that sums the
scores of some left items gets those items with the whole right part, items as
numbers, and makes the pairs in memory. Tasks have about equally many pairs; the
right items of a hot left item are dealt to several tasks. What is shuffled is
still in proportion to the pairs, so it goes in passes over the left items,
each a small multiple of the rows, and its files go with the pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.dates import trailing
from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import sorted_rank
from cartwheel.functions.stage import cut, discard

PART_ITEMS = 500
TASK_PAIRS = 4_000_000          # pairs that a task holds at once
PASS_PAIRS = 50_000_000         # pairs of a pass, or PASS_ROWS pairs a row if they are more
PASS_ROWS = 6
_BUCKETS = 4096                 # left items are weighed by hash bucket; a row of this length a task goes to the driver


def bought_same_day(history: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """Partner by baskets of one customer and day; repeated rows count with multiplicity."""
    rows = (history.select("customer_id", "t_dat", "article_id").dropna()
            .groupBy("customer_id", "t_dat", "article_id").agg(F.count(F.lit(1)).cast("double").alias("w")))
    baskets = rows.select(F.struct("customer_id", "t_dat").alias("basket"), F.col("article_id").alias("item"),
                          F.col("w").alias("left_w"), F.col("w").alias("right_w"))
    return best_partner(baskets, part_items)


def bought_by_same_customer(history: DataFrame, window: str = "1w", part_items: int = PART_ITEMS) -> DataFrame:
    """Partner among everything an article's buyers bought in the window.

    A buyer counts once for the article, its other purchases with multiplicity.
    """
    rows = (trailing(history, window).select("customer_id", "article_id").dropna()
            .groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).cast("double").alias("w")))
    baskets = rows.select(F.struct("customer_id").alias("basket"), F.col("article_id").alias("item"),
                          F.lit(1.0).alias("left_w"), F.col("w").alias("right_w"))
    return best_partner(baskets, part_items)


def best_partner(baskets: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(article_id, partner_id, cnt): highest score, ties to the smaller partner id.

    ``baskets`` holds distinct (basket, item) rows, kept as a table because
    their sizes and the items' numbers read them. Numbers follow the order of
    the items.
    """
    rows = cut(baskets)
    items = cut(sorted_rank(rows.select("item").filter(F.col("item").isNotNull()).distinct(), ["item"], "_id").select("item", F.col("_id").cast("int").alias("id")))
    whole, split = _parts(rows, items, part_items)
    alone = whole.select("l", "lw", F.col("l").alias("r"), "rw")
    blocks = alone if split is None else alone.unionByName(split)
    first, deal, passes = _plan(_pairs_by_bucket(blocks), PASS_ROWS * _entries(blocks))
    tables = [cut(_best_of_pass(blocks, first, deal, begin, end)) for begin, end in passes]
    if not tables:
        return baskets.select(F.col("item").alias("article_id"), F.col("item").alias("partner_id"), F.lit(0).cast("long").alias("cnt")).limit(0)
    found = tables[0]
    for best in tables[1:]:
        found = found.unionByName(best)
    best = found.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("neg"), "b")).alias("best")).select("a", "best.neg", "best.b")
    named = best.join(items.select(F.col("id").alias("a"), F.col("item").alias("article_id")), "a")
    named = skew_join(named, items.select(F.col("id").alias("b"), F.col("item").alias("partner_id")), ["b"], "inner")
    result = cut(named.select("article_id", "partner_id", (-F.col("neg")).cast("long").alias("cnt")))
    for stored in (items, whole, split, *tables):
        if stored is not None:
            discard(stored)
    return result


def _parts(rows: DataFrame, items: DataFrame, part_items: int) -> tuple[DataFrame, DataFrame | None]:
    """Stage tables of item numbers and weights as arrays: of whole baskets (l, lw, rw), and of the pairs of parts (l, lw, r, rw) of larger ones."""
    large = cut(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_items)
                .select("basket", F.ceil(F.col("_n") / part_items).cast("int").alias("parts")))
    coded = cut(skew_join(rows, items, ["item"], "inner").drop("item"))
    discard(rows)
    dealt = skew_join(coded, large, ["basket"]).withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0)))
    packed = dealt.groupBy("basket", "own", "parts").agg(F.collect_list(F.struct("id", "left_w", "right_w")).alias("_e"))
    arrays = [F.col("_e.id").alias("l"), F.col("_e.left_w").alias("lw"), F.col("_e.right_w").alias("rw")]
    packed = packed.filter(F.col("parts").isNotNull() | (F.size("_e") > 1))
    if large.isEmpty():
        packed = cut(packed.select(*arrays))
        discard(coded)
        return packed, None
    packed = cut(packed.select("basket", "own", "parts", *arrays))
    discard(coded)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    several = packed.filter(F.col("parts").isNotNull())
    left = several.select("basket", F.col("own").alias("part_a"), every.alias("part_b"), "l", "lw")
    right = several.select("basket", every.alias("part_a"), F.col("own").alias("part_b"), F.col("l").alias("r"), "rw")
    return (cut(packed.filter(F.col("parts").isNull()).select("l", "lw", "rw")),
            cut(left.join(right, ["basket", "part_a", "part_b"]).select("l", "lw", "r", "rw")))


def _mixed(ids: np.ndarray, factor: int) -> np.ndarray:
    """Evenly spread 32-bit numbers."""
    x = ids.astype(np.uint64) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return (x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids, 0x9E3779B1) % np.uint64(_BUCKETS)).astype(np.int64)


def _list(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(length of each row's array, all entries)."""
    column = batch.column(name)
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _entries(blocks: DataFrame) -> int:
    """Left entries of all blocks."""
    return blocks.agg(F.sum(F.size("l"))).first()[0] or 0


def _pairs_by_bucket(blocks: DataFrame) -> np.ndarray:
    """Pairs of the left items of each bucket, an item with itself counted too."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            n, left = _list(batch, "l")
            m, _ = _list(batch, "r")
            total += np.bincount(_bucket(left), np.repeat(m, n), _BUCKETS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["task", "pairs"])

    found = blocks.select("l", "r").mapInArrow(emit, "task bigint, pairs binary").collect()        # a row per task
    return sum((np.frombuffer(r.pairs, np.int64) for r in found), np.zeros(_BUCKETS, np.int64))


def _plan(pairs: np.ndarray, pass_pairs: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(first task, number of tasks) of each bucket, and passes as ranges of tasks.

    Light buckets share a task; the right items of a heavy one are dealt to several.
    """
    first, deal = np.zeros(_BUCKETS, np.int64), np.ones(_BUCKETS, np.int64)
    weights: list[float] = []
    room = 0
    for bucket, weight in enumerate(pairs.tolist()):
        if weight > TASK_PAIRS:
            deal[bucket] = -(-weight // TASK_PAIRS)
            first[bucket] = len(weights)
            weights += [weight / deal[bucket]] * int(deal[bucket])
            room = 0
            continue
        if weight > room:
            weights.append(0)
            room = TASK_PAIRS
        first[bucket] = max(0, len(weights) - 1)
        if weight:
            weights[-1] += weight
            room -= weight
    passes, begin, held = [], 0, 0
    for task, weight in enumerate(weights):
        if task > begin and held + weight > max(PASS_PAIRS, pass_pairs):
            passes.append((begin, task))
            begin, held = task, 0
        held += weight
    return first, deal, [*passes, (begin, len(weights))] if weights else []


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_MESSAGE = "task int, n binary, m binary, l binary, lw binary, r binary, rw binary"
_BEST = "a int, score double, b int"


def _best_of_pass(blocks: DataFrame, first: np.ndarray, deal: np.ndarray, begin: int, end: int) -> DataFrame:
    """(a, score, b): the best right item among those of a task, for each of the task's left items."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n, left), (m, right) = _list(batch, "l"), _list(batch, "r")
            lw, rw = _list(batch, "lw")[1], _list(batch, "rw")[1]
            begins, row, bucket = np.cumsum(m) - m, np.repeat(np.arange(len(n)), n), _bucket(left)
            mine = np.flatnonzero((first[bucket] + deal[bucket] > begin) & (first[bucket] < end))
            mine = mine[np.argsort(first[bucket[mine]], kind="stable")]         # rows stay in order
            groups = np.split(mine, np.flatnonzero(np.diff(first[bucket[mine]])) + 1) if len(mine) else []
            for at in groups:                   # left entries of one task, or of a heavy bucket
                rows, count = np.unique(row[at], return_counts=True)
                spans = _spans(begins[rows], m[rows])
                parts = int(deal[bucket[at[0]]])
                side = _mixed(right[spans], 0x85EBCA6B) % np.uint64(parts) if parts > 1 else None
                for part in range(parts):
                    task = int(first[bucket[at[0]]]) + part
                    if not begin <= task < end:
                        continue
                    some, lengths = spans, m[rows]
                    if parts > 1:
                        here = side == part
                        some, lengths = spans[here], np.bincount(np.repeat(np.arange(len(rows)), m[rows])[here], minlength=len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *[pa.array([v.tobytes()]) for v in (
                        count.astype(np.int32), lengths.astype(np.int32), left[at].astype(np.int32), lw[at].astype(float),
                        right[some].astype(np.int32), rw[some].astype(float))]], [c.split()[0] for c in _MESSAGE.split(", ")])

    def best(key, table):
        n, m, left, right = (np.concatenate([np.frombuffer(v, np.int32) for v in table.column(c).to_pylist()]).astype(np.int64) for c in ("n", "m", "l", "r"))
        lw, rw = (np.concatenate([np.frombuffer(v, np.float64) for v in table.column(c).to_pylist()]) for c in ("lw", "rw"))
        return pa.table(_best_pairs(n, m, left, lw, right, rw))

    return blocks.mapInArrow(emit, _MESSAGE).groupBy("task").applyInArrow(best, _BEST)


def _best_pairs(n: np.ndarray, m: np.ndarray, left: np.ndarray, lw: np.ndarray, right: np.ndarray, rw: np.ndarray) -> dict[str, pa.Array]:
    """Best right item of each left item; rows have ``n`` left and ``m`` right entries. Pairs are made and summed ``TASK_PAIRS`` at a time."""
    begins = np.repeat(np.cumsum(m) - m, n)     # of each left entry
    lengths = np.repeat(m, n)
    ids, left = np.unique(left, return_inverse=True)
    others, right = np.unique(right, return_inverse=True)
    own = np.searchsorted(ids, others)
    own = np.where((own < len(ids)) & (ids[np.minimum(own, max(0, len(ids) - 1))] == others), own, -1) if len(ids) else own
    keys, sums = np.zeros(0, np.int64), np.zeros(0)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASK_PAIRS, "right")))
        places = _spans(begins[at:upto], lengths[at:upto])
        a, b = np.repeat(left[at:upto], lengths[at:upto]), right[places]
        weight = np.repeat(lw[at:upto], lengths[at:upto]) * rw[places]
        apart = own[b] != a
        keys, sums = _summed(np.concatenate([keys, (a * len(others) + b)[apart]]), np.concatenate([sums, weight[apart]]))
        at = upto
    if not len(keys):
        return dict(zip(("a", "score", "b"), (pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.int32()))))
    a = keys // len(others)
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    most = np.maximum.reduceat(sums, starts)
    ties = np.flatnonzero(sums == np.repeat(most, np.diff(np.append(starts, len(a)))))
    chosen = ties[np.searchsorted(ties, starts)]        # keys rise, so the first is the smallest right item
    return {"a": pa.array(ids[a[chosen]].astype(np.int32)), "score": pa.array(most), "b": pa.array(others[keys[chosen] % len(others)].astype(np.int32))}


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values[order], starts)
