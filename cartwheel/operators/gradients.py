"""Gradients of the buy models: pointwise log loss, and pairs weighted by what a swap changes in the ranking metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# groups of about this many rows are worked on at once
BATCH_ROWS = 50_000


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... ``sizes`` times for each entry."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def log_loss_gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chance = np.exp(-np.logaddexp(0, -margin))
    return chance - label, chance * (1 - chance)


class Ranked:
    """Rows of several groups, each group by falling score; equal scores keep their order."""

    def __init__(self, score: np.ndarray, label: np.ndarray, sizes: np.ndarray, cutoff: int):
        group = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.lexsort((-score, group))
        self.score, self.label, self.cutoff = score[self.order], label[self.order] > 0, cutoff
        self.start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = np.arange(len(score)) - self.start
        self.size = np.repeat(sizes, sizes)
        hits = np.append(0, np.cumsum(self.label))
        self.hits = hits[1:] - hits[self.start]                  # up to and with each place
        self.positives = hits[self.start + self.size] - hits[self.start]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) rows with unlike labels, the upper one inside the cutoff: no other swap changes the metric."""
        upper = np.flatnonzero((self.place < self.cutoff) & (self.positives > 0) & (self.positives < self.size))
        below = self.size[upper] - self.place[upper] - 1
        lower, upper = spread(upper + 1, below), np.repeat(upper, below)
        unlike = self.label[upper] != self.label[lower]
        return upper[unlike], lower[unlike]

    def ndcg_changes(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        discount = 1 / np.log2(np.arange(self.cutoff) + 2.0)
        ideal = np.append(0, np.cumsum(discount))
        at = lambda rows: np.append(discount, 0)[np.minimum(self.place[rows], self.cutoff)]
        return np.abs(at(upper) - at(lower)) / ideal[np.minimum(self.positives[upper], self.cutoff)]

    def map_changes(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Change of the average precision: the two places' own terms, and a hit more or less for the hits between them."""
        inside = self.place < self.cutoff
        per_hit = np.append(0, np.cumsum(np.where(self.label & inside, 1 / (self.place + 1.0), 0)))
        first, last = self.place[upper] + 1, self.place[lower] + 1
        between = per_hit[lower] - per_hit[upper + 1]
        above = (self.hits[upper] + ~self.label[upper]) / first
        below = np.where(inside[lower], self.hits[lower] / last, 0)
        return (above + between - below) / np.minimum(self.positives[upper], self.cutoff)


def ranking_gradients(score: np.ndarray, label: np.ndarray, sizes: np.ndarray, cutoff: int = 12, metric: str = "ndcg") -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of the pairwise logistic loss inside groups, each pair weighted by its swap's change."""
    ranked = Ranked(score, label, sizes, cutoff)
    upper, lower = ranked.pairs()
    weight = (ranked.ndcg_changes if metric == "ndcg" else ranked.map_changes)(upper, lower)
    better = np.where(ranked.label[upper], upper, lower)
    worse = upper + lower - better
    doubt = np.exp(-np.logaddexp(0, ranked.score[better] - ranked.score[worse]))
    pull, bend = weight * doubt, weight * doubt * (1 - doubt)
    count = len(score)
    gradient = np.bincount(worse, pull, count) - np.bincount(better, pull, count)
    hessian = np.bincount(worse, bend, count) + np.bincount(better, bend, count)
    back = np.empty((2, count))
    back[:, ranked.order] = gradient, hessian
    return back[0], back[1]


def average_precisions(score: np.ndarray, label: np.ndarray, sizes: np.ndarray, truth: np.ndarray, cutoff: int = 12) -> np.ndarray:
    """Average precision of each group; ``truth`` counts what there was to find, also outside the rows."""
    ranked = Ranked(score, label, sizes, cutoff)
    term = np.where(ranked.label & (ranked.place < cutoff), ranked.hits / (ranked.place + 1.0), 0)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), term, len(sizes)) / np.maximum(np.minimum(truth, cutoff), 1)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = BATCH_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group sizes) of about ``rows`` rows from batches sorted by ``key``; no group is in two tables."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            edges = _edges(table.column(key))
            if len(edges) > 1:                  # the last group may go on
                yield table.slice(0, edges[-1]), np.diff(edges)
                table = table.slice(edges[-1])
            held, count = table.to_batches(), table.num_rows
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.diff(np.append(_edges(table.column(key)), table.num_rows))


def _edges(column: pa.ChunkedArray) -> np.ndarray:
    """Where a new value begins; null is a value."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def add_ranking_gradients(frame: DataFrame, score: str, label: str = "buy", group: str = "customer_id", order: tuple[str, ...] = ("article_id",),
                          cutoff: int = 12, metric: str = "ndcg") -> DataFrame:
    """``frame`` with the columns ``gradient`` and ``hessian`` of the pairwise ranking loss.

    Rows of a group are ranked by falling ``score``, equal scores by ``order``.
    Only pairs with a row inside the cutoff count, so a group costs ``cutoff``
    times its rows. A group is one customer's candidates, whose number the
    strategies' limits bound; it is worked on whole.
    """
    sorted_rows = frame.repartition(group).sortWithinPartitions(group, *order)
    schema = sorted_rows.schema.add("gradient", "double").add("hessian", "double")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, group):
            scores, labels = (table.column(c).cast(pa.float64()).to_numpy() for c in (score, label))
            for name, values in zip(("gradient", "hessian"), ranking_gradients(scores, labels, sizes, cutoff, metric)):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches()

    return sorted_rows.withColumn(score, F.col(score).cast("double")).mapInArrow(emit, _with_double(schema, score))


def _with_double(schema, name: str):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == name else f for f in schema.fields])
