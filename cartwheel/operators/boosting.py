"""Gradient boosting over a binned feature table: leaves split best first, log loss or ranking loss, rounds chosen by a metric.

Rows are packed into blocks of whole groups, with a bin number per numeric
feature and a 64-bit code per category value. For each level of a tree Spark
adds up gradient histograms by (leaf, feature) from all blocks, finds the best
split of each leaf where its histogram is, and sends one record per leaf to the
driver, which keeps the queue of leaves. A category of at most ``LISTED`` values
has a histogram over the sorted list of its codes. Values of larger ones are
never numbered: their sums are grouped by code. Codes are ordered by gradient
over hessian, and a split names at most ``cat_most`` of them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cartwheel.functions.stage import cut, discard
from cartwheel.operators import gradients as G

BLOCK_ROWS = 50_000
LISTED = 4096           # values of a category whose codes are listed on the driver


class Params(NamedTuple):
    """``objective`` is "log_loss", "ndcg" or "map"; the latter two rank inside groups."""
    objective: str = "log_loss"
    rounds: int = 100
    learning_rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 1e-3
    bins: int = 255
    feature_share: float = 1.0
    row_share: float = 1.0
    cutoff: int = 12
    patience: int = 100
    window: int = 10            # rounds between two looks at the metric
    cat_most: int = 32
    cat_smooth: float = 10.0
    cat_min_rows: int = 10
    seed: int = 0


# fixed values: the settings of a production training
PRODUCTION = Params(rounds=20_000, learning_rate=0.01, leaves=100, min_rows=100, l1=2.652545580792273e-07, l2=4.127044972448657e-07,
                    feature_share=0.7, row_share=0.7235734670479185, patience=100, seed=42)


class Node(NamedTuple):
    """A split (``feature`` >= 0) or a leaf. Numbers go left up to a bin, categories if they are named; missing numbers where ``missing`` says."""
    feature: int
    bin: int
    missing: bool
    codes: tuple[int, ...]
    left: int
    right: int
    value: float
    gain: float
    rows: int


class Booster(NamedTuple):
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]        # upper ends of the bins of each number
    base: float
    trees: tuple[tuple[Node, ...], ...]
    objective: str
    history: tuple[tuple[int, float, float], ...] = ()      # (rounds, log loss, MAP) on the validation rows

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.categories]


# ---- rows in blocks -------------------------------------------------------------------

def code_of(column: str) -> Column:
    """64-bit code of a category value; null counts as empty text."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def split_types(frame: DataFrame, features: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    kinds = dict(frame.dtypes)
    text = tuple(f for f in features if kinds[f] == "string")
    return tuple(f for f in features if f not in text), text


def bin_edges(frame: DataFrame, numbers: Sequence[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Quantiles of every number over all rows, in one aggregate; at most ``bins`` a feature come to the driver."""
    if not numbers:
        return ()
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = frame.agg(*[F.percentile_approx(finite(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
    return tuple(tuple(sorted(set(q or ()))) for q in row)


class Layout(NamedTuple):
    """Where a feature's values are in a block: numbers and listed categories among the bins, other categories among the codes."""
    numbers: int
    lists: tuple[np.ndarray | None, ...]        # sorted codes of each category, None if it has too many

    def row(self, feature: int) -> int:
        before = self.lists[:max(0, feature - self.numbers)]
        if feature < self.numbers:
            return feature
        listed = sum(x is not None for x in before)
        return self.numbers + listed if self.listed(feature) else len(before) - listed

    def listed(self, feature: int) -> bool:
        return feature >= self.numbers and self.lists[feature - self.numbers] is not None

    def wide(self, feature: int) -> bool:
        return feature >= self.numbers and self.lists[feature - self.numbers] is None

    def bins(self, feature: int, bins: int) -> int:
        """Length of the feature's histogram; the last place of a list is for other codes."""
        return len(self.lists[feature - self.numbers]) + 1 if self.listed(feature) else bins + 2


def code_lists(frame: DataFrame, categories: Sequence[str]) -> tuple[np.ndarray | None, ...]:
    """The sorted codes of every category of about ``LISTED`` values or fewer; None for the others."""
    if not categories:
        return ()
    about = frame.agg(*[F.approx_count_distinct(code_of(c)).alias(f"n{i}") for i, c in enumerate(categories)]).first()
    few = [c for c, n in zip(categories, about) if n <= LISTED]
    row = frame.agg(*[F.collect_set(code_of(c)).alias(f"s{i}") for i, c in enumerate(few)]).first() if few else ()
    found = {c: np.array(sorted(codes), np.int64) for c, codes in zip(few, row)}
    return tuple(found.get(c) for c in categories)


BLOCKS = "block bigint, n int, bins binary, codes binary, label binary, sizes binary, hash binary, truth binary, margin binary"


def _bin(values: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    """0 for missing, else one more than the number of edges below."""
    found = np.searchsorted(np.asarray(edges, float), values, "left") + 1
    return np.where(np.isnan(values), 0, np.minimum(found, len(edges))).astype(np.uint16)


def _place(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted list, its length for codes that it lacks."""
    found = np.searchsorted(known, codes)
    return np.where((found < len(known)) & (known[np.minimum(found, len(known) - 1)] == codes), found, len(known)) if len(known) else found


def _row_bytes(columns: Sequence[np.ndarray], n: int, kind: type) -> pa.Array:
    """The values of each row side by side, as bytes."""
    matrix = np.stack(columns, axis=1).astype(kind) if columns else np.zeros((n, 0), kind)
    return pa.array([row.tobytes() for row in matrix], pa.binary()) if not matrix.size else pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * matrix.strides[0]).astype(np.int32).tobytes()), pa.py_buffer(matrix.tobytes())])


def pack(frame: DataFrame, numbers: Sequence[str], categories: Sequence[str], edges, label: str = "buy", group: str = "customer_id",
         item: str = "article_id", truth: str | None = None, lists: Sequence[np.ndarray | None] | None = None) -> DataFrame:
    """BLOCKS of whole groups, rows of a group by ``item``.

    Codes of categories with a list become places in it, one byte each if no
    feature needs more; a code that is not listed has the place behind the last.

    ``truth`` names a column with the number of purchases to find per group; without it those
    among the rows count. Rows that repeat a pair stay; the metric takes the best of them.
    """
    lists = lists or [None] * len(categories)
    kind = np.uint8 if max([0, *map(len, edges), *(len(x) for x in lists if x is not None)]) < 256 else np.uint16
    values = [*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numbers)], *[code_of(c).alias(f"_c{i}") for i, c in enumerate(categories)]]
    slim = frame.select(F.col(group).cast("string").alias("_group"), F.col(item).cast("string").alias("_item"), F.col(label).cast("double").alias("_label"),
                        (F.col(truth).cast("double") if truth else F.lit(None).cast("double")).alias("_truth"), *values)
    names = [*[f"_x{i}" for i in range(len(numbers))], *[f"_c{i}" for i in range(len(categories))]]
    slim = slim.withColumn("_hash", F.xxhash64("_group", "_item", *names))

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = [batch.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(len(categories))]
            bins = [_bin(batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float), e) for i, e in enumerate(edges)]
            bins = [*bins, *(_place(v, known) for v, known in zip(codes, lists) if known is not None)]
            wide = [v for v, known in zip(codes, lists) if known is None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _row_bytes(bins, n, kind), _row_bytes(wide, n, np.int64)], [*kept, "_b", "_w"])

    kept = ["_group", "_item", "_label", "_truth", "_hash"]
    binned = slim.mapInArrow(bin_, "_group string, _item string, _label double, _truth double, _hash bigint, _b binary, _w binary")
    spread = binned.repartition("_group").sortWithinPartitions("_group", "_item", "_hash")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in G.whole_groups(batches, "_group", BLOCK_ROWS):
            n = table.num_rows
            column = lambda name: table.column(name).combine_chunks()
            bins, codes = (np.ascontiguousarray(np.frombuffer(b"".join(table.column(c).to_pylist()), k).reshape(n, -1).T) for c, k in (("_b", kind), ("_w", np.int64)))
            y = column("_label").to_numpy(zero_copy_only=False)
            item_edges = np.zeros(n, np.uint8)
            item_edges[G._edges(table.column("_item"))] = 1
            item_edges[np.cumsum(sizes) - sizes] = 1
            starts = np.cumsum(sizes) - sizes
            # purchases of a group: distinct items with a label, unless told
            bought = np.add.reduceat(np.maximum.reduceat(y, np.flatnonzero(item_edges)), np.searchsorted(np.flatnonzero(item_edges), starts))
            told = column("_truth").to_numpy(zero_copy_only=False)[starts].astype(float)
            hashes = column("_hash").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((
                int(hashes[0]), n, bytes([kind().itemsize]) + bins.tobytes(), np.ascontiguousarray(codes, np.int64).tobytes(), y.astype(np.float32).tobytes(),
                sizes.astype(np.int32).tobytes() + item_edges.tobytes(), hashes.astype(np.int64).tobytes(),
                np.where(np.isnan(told), bought, told).tobytes(), np.zeros(n).tobytes()), _ARROW)], schema=_ARROW)

    return spread.mapInArrow(emit, BLOCKS)


_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "codes", "label", "sizes", "hash", "truth", "margin")]])


def _matrix(data, n: int) -> np.ndarray:
    """Bins by feature, behind a byte that tells the width of a bin."""
    values = memoryview(data)
    return np.frombuffer(values[1:], np.uint8 if values[0] == 1 else np.uint16).reshape(-1, n)


class Block:
    """One block's arrays."""

    def __init__(self, row: dict):
        n = self.n = row["n"]
        self.bins = _matrix(row["bins"], n)
        self.codes = np.frombuffer(row["codes"], np.int64).reshape(-1, n)
        self.label = np.frombuffer(row["label"], np.float32).astype(float)
        self.sizes = np.frombuffer(row["sizes"][:-n], np.int32).astype(np.int64)
        self.new_item = np.frombuffer(row["sizes"][-n:], np.uint8).astype(bool)
        self.hash = np.frombuffer(row["hash"], np.int64)
        self.truth = np.frombuffer(row["truth"], np.float64)
        self.margin = np.frombuffer(row["margin"], np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, Block(row)


def leaf_of(tree: Sequence[Node], bins: np.ndarray, codes: np.ndarray, layout: Layout | None = None) -> np.ndarray:
    """The node that each row ends in. Without a layout all categories are among the codes."""
    count = bins.shape[1] if len(bins) else codes.shape[1]
    layout = layout or Layout(len(bins), (None,) * len(codes))
    found = np.zeros(count, np.int32)
    rows_of = {0: np.arange(count)}
    for number, node in enumerate(tree):        # children stand behind their parent
        rows = rows_of.pop(number)
        if node.feature < 0 or not len(rows):
            found[rows] = number
            if node.feature >= 0:
                rows_of[node.left] = rows_of[node.right] = rows
            continue
        at = layout.row(node.feature)
        if layout.wide(node.feature):
            left = np.isin(codes[at][rows], node.codes)
        elif layout.listed(node.feature):
            left = np.append(np.isin(layout.lists[node.feature - layout.numbers], node.codes), False)[bins[at][rows]]
        else:
            value = bins[at][rows]
            left = np.where(value == 0, node.missing, value <= node.bin)
        rows_of[node.left], rows_of[node.right] = rows[left], rows[~left]
    return found


def _margin(trees: Sequence[Sequence[Node]], bins: np.ndarray, codes: np.ndarray, start: np.ndarray, layout: Layout | None = None) -> np.ndarray:
    total = start.copy()
    for tree in trees:
        total += np.array([n.value for n in tree])[leaf_of(tree, bins, codes, layout)]
    return total


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Evenly spread numbers in [0, 1) from hashes and a seed."""
    x = values.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0 ** 64


# ---- one round ------------------------------------------------------------------------

GRADED = "n int, bins binary, codes binary, gradient binary, hessian binary"


def _graded(blocks: DataFrame, trees, base: float, params: Params, round_: int, layout: Layout) -> DataFrame:
    """Gradients of every row in the bag after the given trees (those since the margins were last stored)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches):
            margin = _margin(trees, block.bins, block.codes, block.margin, layout) + base
            if params.objective == "log_loss":
                gradient, hessian = G.log_loss_gradients(margin, block.label)
            else:
                gradient, hessian = G.ranking_gradients(margin, block.label, block.sizes, params.cutoff, params.objective)
            if params.row_share < 1:
                out = _mixed(block.hash, params.seed * 1_000_003 + round_) >= params.row_share
                gradient[out], hessian[out] = np.nan, 0
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row["n"], row["bins"], row["codes"], gradient.tobytes(), hessian.tobytes())],
                                             schema=pa.schema([("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "codes", "gradient", "hessian")]]))

    return blocks.mapInArrow(emit, GRADED)


HISTOGRAMS = "feature int, task int, data binary"
SUMS = "node int, feature int, code bigint, g double, h double, rows double"
SPLITS = "node int, feature int, gain double, bin int, missing boolean, codes array<bigint>, g double, h double, rows double"


def _soft(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _score(g, h, params: Params):
    return _soft(g, params.l1) ** 2 / (h + params.l2 + 1e-300)


def _open_rows(batches: Iterator[pa.RecordBatch], tree: Sequence[Node], open_: Sequence[int], layout: Layout) -> Iterator[tuple]:
    """(bins, codes, rows, slot, gradient, hessian) of every block: its rows in the bag that end in an open node, and the place of that node."""
    slot_of = np.full(len(tree), -1)
    slot_of[list(open_)] = np.arange(len(open_))
    for _, packed, codes, gradient, hessian in _graded_rows(batches):
        slot = slot_of[leaf_of(tree, packed, codes, layout)]
        rows = np.flatnonzero((slot >= 0) & ~np.isnan(gradient))
        yield packed, codes, rows, slot[rows], gradient[rows], hessian[rows]


def _histograms(graded: DataFrame, tree: Sequence[Node], wanted: Sequence[int], open_: Sequence[int], bins: int, layout: Layout) -> DataFrame:
    """HISTOGRAMS of the rows of open nodes, per task and feature those of all the nodes, for numbers and listed categories."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [f for f in wanted if not layout.wide(f)]
        total = {f: np.zeros((3, len(open_) * layout.bins(f, bins))) for f in features}
        for packed, _, rows, slot, g, h in _open_rows(batches, tree, open_, layout):
            for f in features:
                key = slot * layout.bins(f, bins) + packed[layout.row(f)][rows]
                for sums, weight in zip(total[f], (g, h, None)):
                    sums += np.bincount(key, weight, len(sums))
        task = TaskContext.get().partitionId()
        found = [(f, task, part.tobytes()) for f, part in total.items() if part[2].any()]
        columns = list(zip(*found)) or [[] for _ in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], [c.split()[0] for c in HISTOGRAMS.split(", ")])

    return graded.mapInArrow(emit, HISTOGRAMS)


def _code_sums(graded: DataFrame, tree: Sequence[Node], wanted: Sequence[int], open_: Sequence[int], layout: Layout) -> DataFrame:
    """SUMS of the rows of open nodes for categories without a list: a row per block, node and code."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, rows, slot, g, h in _open_rows(batches, tree, open_, layout):
            for f in (f for f in wanted if layout.wide(f)):
                value, place = np.unique(codes[layout.row(f)][rows], return_inverse=True)
                pair, place = np.unique(slot * len(value) + place, return_inverse=True)
                parts = [np.bincount(place, w, len(pair)).astype(float) for w in (g, h, None)]
                nodes = np.array(open_, np.int32)[pair // max(1, len(value))]
                code = value[pair % max(1, len(value))] if len(value) else value
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(pair), f, np.int32)), pa.array(code), *map(pa.array, parts)],
                                                 [c.split()[0] for c in SUMS.split(", ")])

    return graded.mapInArrow(emit, SUMS)


def _graded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at, n in enumerate(batch.column("n").to_pylist()):
            data = {c: batch.column(c)[at].as_buffer() for c in ("bins", "codes", "gradient", "hessian")}
            yield n, _matrix(data["bins"], n), np.frombuffer(data["codes"], np.int64).reshape(-1, n), *(np.frombuffer(data[c], np.float64) for c in ("gradient", "hessian"))


def _totals(graded: DataFrame) -> tuple[float, float, float]:
    """(gradient, hessian, rows) of all rows in the bag."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3)
        for *_, gradient, hessian in _graded_rows(batches):
            kept = ~np.isnan(gradient)
            total += gradient[kept].sum(), hessian[kept].sum(), kept.sum()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), *[pa.array([v]) for v in total.tolist()]], ["task", "g", "h", "rows"])

    found = sorted(graded.mapInArrow(emit, "task bigint, g double, h double, rows double").collect())       # a row per task
    return tuple(sum(r[i] for r in found) for i in (1, 2, 3)) if found else (0.0, 0.0, 0.0)


def best_number_split(hist: np.ndarray, params: Params) -> tuple | None:
    """(gain, bin, missing left, g, h, rows of the left side) of a histogram (3, bins); bin 0 is missing."""
    all_ = hist.sum(axis=1)
    parent = _score(all_[0], all_[1], params)
    best = None
    below = np.cumsum(hist[:, 1:], axis=1)
    for missing, left in ((True, np.concatenate([hist[:, :1], below + hist[:, :1]], axis=1)), (False, np.concatenate([np.zeros((3, 1)), below], axis=1))):
        right = all_[:, None] - left
        fine = (np.minimum(left[2], right[2]) >= max(1, params.min_rows)) & (np.minimum(left[1], right[1]) >= params.min_hessian)
        if not fine.any():
            continue
        gain = np.where(fine, _score(left[0], left[1], params) + _score(right[0], right[1], params) - parent, -np.inf)
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[0]:
            best = (float(gain[at]), at, missing, *left[:, at].tolist())
    return best


def best_category_split(codes: np.ndarray, three: np.ndarray, all_: np.ndarray, params: Params) -> tuple | None:
    """(gain, codes, g, h, rows of the left side): prefixes of the codes by rising and by falling gradient over hessian."""
    ratio = three[0] / (three[1] + params.cat_smooth)
    best, parent = None, _score(all_[0], all_[1], params)
    for order in (np.lexsort((codes, ratio)), np.lexsort((codes, -ratio))):
        order = order[:params.cat_most]
        left = np.cumsum(three[:, order], axis=1)
        right = all_[:, None] - left
        fine = (np.minimum(left[2], right[2]) >= max(1, params.min_rows)) & (np.minimum(left[1], right[1]) >= params.min_hessian)
        if not fine.any():
            continue
        gain = np.where(fine, _score(left[0], left[1], params) + _score(right[0], right[1], params) - parent, -np.inf)
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[0]:
            best = (float(gain[at]), codes[order[:at + 1]].tolist(), *left[:, at].tolist())
    return best


_SPLIT_ARROW = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("missing", pa.bool_()),
                          ("codes", pa.list_(pa.int64())), *[(c, pa.float64()) for c in ("g", "h", "rows")]])


def _best_splits(graded: DataFrame, tree: Sequence[Node], wanted: Sequence[int], open_: Sequence[int], totals: dict, params: Params, layout: Layout) -> DataFrame:
    """SPLITS with a gain: the best one of every open node and feature, found where its sums are."""
    def listed(key, table):
        table = table.sort_by("task")           # the same order of additions on every run
        hist = np.add.reduce([np.frombuffer(d, np.float64).reshape(3, len(open_), -1) for d in table.column("data").to_pylist()])
        found, f = [], key[0].as_py()
        for slot, node in enumerate(open_):
            sums = hist[:, slot]
            if layout.listed(f):
                often = np.flatnonzero(sums[2, :-1] >= max(1, params.cat_min_rows))
                best = best_category_split(layout.lists[f - layout.numbers][often], sums[:, often], np.array(totals[node]), params)
                best = best and (best[0], -1, False, best[1], *best[2:])
            else:
                best = best_number_split(sums, params)
                best = best and (*best[:3], [], *best[3:])
            if best and best[0] > 0:
                found.append(dict(zip(_SPLIT_ARROW.names, (node, f, *best))))
        return pa.Table.from_pylist(found, _SPLIT_ARROW)

    def categories(key, table):
        code, at = np.unique(table.column("code").to_numpy(), return_index=True)         # a code may be near both ends
        three = np.stack([table.column(c).to_numpy()[at] for c in ("g", "h", "rows")])
        best = best_category_split(code, three, np.array(totals[key[0].as_py()]), params)
        found = [dict(zip(_SPLIT_ARROW.names, (key[0].as_py(), key[1].as_py(), best[0], -1, False, best[1], *best[2:])))] if best and best[0] > 0 else []
        return pa.Table.from_pylist(found, _SPLIT_ARROW)

    parts = []
    if not all(layout.wide(f) for f in wanted):
        tasks = min(len(wanted), graded.sparkSession.sparkContext.defaultParallelism)
        parts.append(_histograms(graded, tree, wanted, open_, params.bins, layout).repartition(tasks, "feature").groupBy("feature").applyInArrow(listed, SPLITS))
    if any(layout.wide(f) for f in wanted):
        by_code = (_code_sums(graded, tree, wanted, open_, layout).groupBy("node", "feature", "code").agg(*[F.sum(c).alias(c) for c in ("g", "h", "rows")])
                   .filter(F.col("rows") >= params.cat_min_rows))
        ratio, here = F.col("g") / (F.col("h") + params.cat_smooth), Window.partitionBy("node", "feature")
        # both ends of the order alone: each map task sends no more than that
        ends = [by_code.withColumn("_r", F.row_number().over(here.orderBy(o, "code"))).filter(F.col("_r") <= params.cat_most).drop("_r") for o in (ratio.asc(), ratio.desc())]
        parts.append(ends[0].union(ends[1]).groupBy("node", "feature").applyInArrow(categories, SPLITS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _grow(graded: DataFrame, wanted: Sequence[int], params: Params, layout: Layout) -> tuple[Node, ...]:
    """A tree of at most ``leaves`` leaves, those with the largest gain split first.

    A pass over the rows looks at all leaves that may still be split, so there
    are as many passes as levels. Splits that the queue never reaches are
    dropped again.
    """
    leaf = lambda g, h, rows: Node(-1, -1, False, (), -1, -1, float(-params.learning_rate * _soft(g, params.l1) / (h + params.l2)) if rows else 0.0, 0.0, int(rows))
    totals = {0: _totals(graded)}
    tree: list[Node] = [leaf(*totals[0])]
    splits: dict[int, object] = {}
    open_ = [0]
    while True:
        for r in _best_splits(graded, tree, wanted, open_, totals, params, layout).collect():        # a record per open leaf and feature
            if r.node not in splits or (-r.gain, r.feature) < (-splits[r.node].gain, splits[r.node].feature):
                splits[r.node] = r
        queue, taken, waiting = [], [], False
        push = lambda n: n in splits and splits[n].gain > 0 and heapq.heappush(queue, (-splits[n].gain, n))
        push(0)
        while queue and len(taken) < params.leaves - 1:
            _, node = heapq.heappop(queue)
            taken.append(node)
            if tree[node].feature < 0:
                waiting = True                  # its children's gains are not known yet
                break
            push(tree[node].left)
            push(tree[node].right)
        if not waiting:
            break
        # the leaves that the rest of the budget may reach
        ready = sorted((-splits[n].gain, n) for n, node in enumerate(tree) if node.feature < 0 and n in splits and splits[n].gain > 0)
        open_ = []
        for _, n in ready[:params.leaves - len(taken)]:
            r = splits[n]
            left = (r.g, r.h, r.rows)
            right = tuple(a - b for a, b in zip(totals[n], left))
            tree[n] = tree[n]._replace(feature=r.feature, bin=r.bin, missing=bool(r.missing), codes=tuple(r.codes), left=len(tree), right=len(tree) + 1, gain=r.gain)
            for side in (left, right):
                totals[len(tree)] = side
                open_.append(len(tree))
                tree.append(leaf(*side))
    return _pruned(tree, set(taken))


def _pruned(tree: Sequence[Node], kept: set[int]) -> tuple[Node, ...]:
    """The tree with the kept splits alone, parents before children."""
    found: list[Node] = []
    place = {0: 0}
    queue = [0]
    while queue:
        n = queue.pop(0)
        node = tree[n]
        if n in kept:
            ahead = len(queue) + len(found) + 1
            place[node.left], place[node.right] = ahead, ahead + 1
            queue += [node.left, node.right]
            node = node._replace(left=ahead, right=ahead + 1)
        else:
            node = node._replace(feature=-1, bin=-1, missing=False, codes=(), left=-1, right=-1, gain=0.0)
        found.append(node)
    return tuple(found)


# ---- training -------------------------------------------------------------------------

def _stored(blocks: DataFrame, trees, layout: Layout) -> DataFrame:
    """The blocks with margins that hold the given trees."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches):
            row["margin"] = _margin(trees, block.bins, block.codes, block.margin, layout).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ARROW], schema=_ARROW)

    return cut(blocks.mapInArrow(emit, BLOCKS))


def staged_metrics(blocks: DataFrame, trees, base: float, cutoff: int = 12, layout: Layout | None = None) -> list[tuple[float, float]]:
    """(log loss, MAP) after each of the trees, in one pass; margins go on from one tree to the next inside a block."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), 4))
        for _, block in _blocks(batches):
            margin = block.margin + base
            starts = np.flatnonzero(block.new_item)
            pairs = np.add.reduceat(block.new_item.astype(np.int64), np.cumsum(block.sizes) - block.sizes)
            label = np.maximum.reduceat(block.label, starts)
            for i, tree in enumerate(trees):
                margin = _margin([tree], block.bins, block.codes, margin, layout)
                loss = np.logaddexp(0, margin) - block.label * margin
                precision = G.average_precisions(np.maximum.reduceat(margin, starts), label, pairs, block.truth, cutoff)
                total[i] += loss.sum(), block.n, precision[block.truth > 0].sum(), (block.truth > 0).sum()
        yield pa.RecordBatch.from_pylist([dict(zip(("round", "loss", "n", "ap", "groups"), (i, *t))) for i, t in enumerate(total.tolist())],
                                         schema=pa.schema([("round", pa.int32()), *[(c, pa.float64()) for c in ("loss", "n", "ap", "groups")]]))

    rows = blocks.mapInArrow(emit, "round int, loss double, n double, ap double, groups double").groupBy("round").agg(
        *[F.sum(c).alias(c) for c in ("loss", "n", "ap", "groups")]).orderBy("round").collect()         # a row per round
    return [(r.loss / r.n if r.n else 0.0, r.ap / r.groups if r.groups else 0.0) for r in rows]


class Packed(NamedTuple):
    """Training and validation rows in blocks, for any number of boosters."""
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    layout: Layout
    blocks: DataFrame
    watched: DataFrame | None
    mean: float             # of the label
    bins: int


def pack_rows(train: DataFrame, features: Sequence[str], valid: DataFrame | None = None, bins: int = Params().bins, label: str = "buy",
              group: str = "customer_id", item: str = "article_id", truth: str | None = None) -> Packed:
    """Null numbers are missing, null categories are empty text. Groups are whole in a block, so a group is bounded by what a task holds."""
    numbers, categories = split_types(train, features)
    edges = bin_edges(train, numbers, bins)
    layout = Layout(len(numbers), code_lists(train, categories))
    blocks = cut(pack(train, numbers, categories, edges, label, group, item, None, layout.lists))
    watched = cut(pack(valid, numbers, categories, edges, label, group, item, truth, layout.lists)) if valid is not None else None
    mean = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    return Packed(numbers, categories, edges, layout, blocks, watched, mean, bins)


def fit(train: DataFrame, features: Sequence[str], params: Params = Params(), valid: DataFrame | None = None, label: str = "buy",
        group: str = "customer_id", item: str = "article_id", truth: str | None = None) -> Booster:
    """A booster of the training rows, see ``boost``."""
    return boost(pack_rows(train, features, valid, params.bins, label, group, item, truth), params)


def boost(packed: Packed, params: Params = Params()) -> Booster:
    """A booster of at most ``params.rounds`` trees.

    With validation rows the metric (log loss, or MAP for the ranking losses) is
    followed round by round; training ends when ``patience`` rounds bring no
    gain, and the trees up to the best round stay.
    """
    if packed.bins != params.bins:
        raise ValueError(f"the rows were packed with {packed.bins} bins")
    numbers, categories, edges, layout, blocks, watched, mean, _ = packed
    base = 0.0
    if params.objective == "log_loss":
        base = float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))
    trees: list[tuple[Node, ...]] = []
    history: list[tuple[int, float, float]] = []
    count = len(numbers) + len(categories)
    best = (np.inf, 0)
    while len(trees) < params.rounds:
        fresh: list[tuple[Node, ...]] = []
        while len(fresh) < params.window and len(trees) + len(fresh) < params.rounds:
            round_ = len(trees) + len(fresh)
            draw = np.random.default_rng([params.seed, round_]).permutation(count)
            wanted = sorted(draw[:max(1, int(np.ceil(count * params.feature_share)))].tolist())
            graded = _graded(blocks, fresh, base, params, round_, layout).persist()
            fresh.append(_grow(graded, wanted, params, layout))
            graded.unpersist()
        if watched is not None:
            for i, (loss, precision) in enumerate(staged_metrics(watched, fresh, base, params.cutoff, layout)):
                history.append((len(trees) + i + 1, loss, precision))
                value = loss if params.objective == "log_loss" else -precision
                if value < best[0]:
                    best = (value, len(trees) + i + 1)
        trees += fresh
        if watched is not None and len(trees) - best[1] >= params.patience:
            break
        if all(len(t) == 1 for t in fresh) and params.row_share == 1 and params.feature_share == 1:
            break                               # nothing is left to split
        if len(trees) < params.rounds:
            older = (blocks, watched) if len(trees) > len(fresh) else ()        # the packed rows themselves stay
            blocks = _stored(blocks, fresh, layout)
            watched = _stored(watched, fresh, layout) if watched is not None else None
            for stored in older:
                if stored is not None:
                    discard(stored)
    kept = trees[:best[1]] if watched is not None else trees
    return Booster(numbers, categories, edges, base, tuple(kept), params.objective, tuple(history))


# ---- use ------------------------------------------------------------------------------

def score(boosters: Sequence[Booster] | Booster, frame: DataFrame, keys: Sequence[str] = ("customer_id", "article_id")) -> DataFrame:
    """(keys, pred): mean prediction of the boosters for every row; a probability for log loss, a margin for the ranking losses."""
    boosters = [boosters] if isinstance(boosters, Booster) else list(boosters)
    numbers = sorted({c for b in boosters for c in b.numbers})
    categories = sorted({c for b in boosters for c in b.categories})
    slim = frame.select(*keys, F.array(*[F.col(c).cast("double") for c in numbers]).cast("array<double>").alias("_x"),
                        F.array(*[code_of(c) for c in categories]).cast("array<bigint>").alias("_c"))
    schema = T.StructType([frame.schema[k] for k in keys] + [T.StructField("pred", T.DoubleType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(numbers))
            codes = batch.column("_c").flatten().to_numpy(zero_copy_only=False).reshape(n, len(categories)).T
            total = np.zeros(n)
            for b in boosters:
                bins = np.stack([_bin(x[:, numbers.index(c)], e) for c, e in zip(b.numbers, b.edges)]) if b.numbers else np.zeros((0, n), np.uint16)
                margin = _margin(b.trees, bins, codes[[categories.index(c) for c in b.categories]], np.full(n, b.base))
                total += np.exp(-np.logaddexp(0, -margin)) if b.objective == "log_loss" else margin
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(total / len(boosters))], [*keys, "pred"])

    return slim.mapInArrow(emit, schema)


def importance(boosters: Sequence[Booster]) -> DataFrame:
    """(feature, importance): share of the total gain, mean over boosters, highest first; as long as the feature list."""
    rows = []
    for i, b in enumerate(boosters):
        gain = dict.fromkeys(b.features, 0.0)
        for tree in b.trees:
            for node in tree:
                if node.feature >= 0:
                    gain[b.features[node.feature]] += node.gain
        whole = sum(gain.values()) or 1.0
        rows += [(f, i, g / whole) for f, g in gain.items()]
    frame = SparkSession.active().createDataFrame(rows, "feature string, model int, importance double")
    return frame.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def save(booster: Booster, path: str) -> None:
    """One row per tree and one for the rest, as parquet."""
    rest = json.dumps(booster._replace(trees=())._asdict())
    rows = [(-1, rest), *((i, json.dumps(tree)) for i, tree in enumerate(booster.trees))]
    SparkSession.active().createDataFrame(rows, "tree int, said string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Booster:
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("tree", "said").collect())      # a model, never data
    rest = json.loads(rows[0][1])
    tuples = lambda value: tuple(tuples(v) for v in value) if isinstance(value, list) else value
    trees = tuple(tuple(Node(*tuples(node)) for node in json.loads(said)) for _, said in rows[1:])
    return Booster(**{k: tuples(v) for k, v in rest.items()})._replace(trees=trees)
