"""Near copies among vectors through an inverted multi-index.

Unit vectors are split into halves, each with a codebook of its own; pairs of
centres form a grid of cells. Every distinct vector lies in the cell of its
nearest centres and visits cells in the order of their summed distances until
the target recall is reached. The number of visits comes from the sample: as
many as would find that share of points turned away by exactly the threshold
angle. In a cell, members and visitors are compared in double precision.

A cell's work is dealt out in blocks of members and of visitors, so a crowded
cell is many bounded groups. A task returns sums and stars, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.components import components

MEMBERS, VISITORS = 2048, 16384


class Index(NamedTuple):
    left: np.ndarray
    right: np.ndarray
    visits: int


def is_usable(column: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)       # first, so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _centres(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None, :]


def fit(sample: np.ndarray, n_vectors: int, threshold: float, recall: float, occupancy: int = 128, most: int = 1024, seed: int = 5) -> Index:
    """Codebooks of about sqrt(n / occupancy) centres, ``most`` at most, and the number of cells to visit."""
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    half = max(1, unit.shape[1] // 2)
    k = int(np.clip(round((n_vectors / occupancy) ** 0.5), 1, min(most, len(unit))))
    index = Index(_centres(unit[:, :half], k, rng), _centres(unit[:, half:], k, rng), 1)
    base = unit[rng.permutation(len(unit))[:2000]]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    norm = np.sqrt((away * away).sum(axis=1, keepdims=True))
    turned = threshold * base + np.sqrt(1 - threshold**2) * np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
    left, right = _halves(index, base)
    home_left, home_right = (d.argmin(axis=1) for d in _halves(index, turned))
    rows = np.arange(len(base))
    target = left[rows, home_left] + right[rows, home_right]
    left, right = np.sort(left, axis=1), np.sort(right, axis=1)
    # cells nearer than the partner's, counted pair by pair of sorted distances
    ranks = np.array([np.searchsorted(r, t - l, "left").sum() for l, r, t in zip(left, right, target)]) + 1
    return index._replace(visits=int(np.quantile(ranks, recall, method="higher")))


def _halves(index: Index, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = index.left.shape[1]
    return _distances(unit[:, :half], index.left), _distances(unit[:, half:], index.right)


def nearest_cells(index: Index, unit: np.ndarray) -> np.ndarray:
    """The first ``visits`` cells of each vector by summed distance, its own cell first."""
    left, right = _halves(index, unit)
    visits = min(index.visits, left.shape[1] * right.shape[1])
    order_left, order_right = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
    # the multi-sequence: a cell of ranks (i, j) is among the first n only if (i + 1)(j + 1) <= n
    i, j = np.meshgrid(np.arange(min(visits, left.shape[1])), np.arange(min(visits, right.shape[1])), indexing="ij")
    near = (i + 1) * (j + 1) <= visits
    i, j = i[near], j[near]
    sums = np.take_along_axis(left, order_left[:, i], axis=1) + np.take_along_axis(right, order_right[:, j], axis=1)
    first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return (np.take_along_axis(order_left[:, i], first, axis=1) * right.shape[1] + np.take_along_axis(order_right[:, j], first, axis=1)).astype(np.int32)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def links(classes: DataFrame, dims: int, index: Index, threshold: float) -> DataFrame:
    """(a, b, n): with b null, n linked vectors of node a; else a link of a star that connects a's block."""
    cells_of = lambda rows: nearest_cells(index, _unit(rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(index.left) * len(index.right)), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                cells = cells_of(_matrix(batch.column("vector").slice(start, 1024), dims))
                total[0] += np.bincount(cells[:, 0], minlength=total.shape[1])
                total[1] += np.bincount(cells.reshape(-1), minlength=total.shape[1])
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0][seen]), pa.array(total[1][seen])], ["cell", "m", "v"])

    counts = classes.select("vector").mapInArrow(count, "cell int, m bigint, v bigint").groupBy("cell").agg(F.sum("m").alias("m"), F.sum("v").alias("v"))
    parts = counts.select("cell", F.ceil(F.greatest("m", F.lit(1)) / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("v") / VISITORS).cast("int").alias("vb"))
    parts = cut(parts.filter((F.col("mb") > 1) | (F.col("vb") > 1)))           # crowded cells; the grid bounds their number

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                cells = cells_of(_matrix(part.column("vector"), dims))
                n, visits = cells.shape
                own = pa.array(cells[:, 0].copy())
                seen = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * visits), pa.array(cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.ones(n, bool)), part.column("node"), part.column("n"), part.column("vector"), own, seen], names)
                again = pa.array(np.repeat(np.arange(n), visits))
                take = lambda c: c.take(again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.reshape(-1)), pa.array(np.zeros(n * visits, bool)), take(part.column("node")), take(part.column("n")), take(part.column("vector")),
                     take(own), pa.array([None] * (n * visits), seen.type)], names)

    names = ["cell", "member", "node", "n", "vector", "own", "seen"]
    kind = classes.schema["vector"].dataType.simpleString()
    rows = classes.select("node", "n", "vector").mapInArrow(emit, f"cell int, member boolean, node bigint, n bigint, vector {kind}, own int, seen array<int>")
    rows = rows.join(F.broadcast(parts), "cell", "left")
    own_part = lambda parts_: F.array(F.pmod(F.xxhash64("node"), F.coalesce(F.col(parts_), F.lit(1))).cast("int"))
    all_parts = lambda parts_: F.sequence(F.lit(0), F.coalesce(F.col(parts_), F.lit(1)) - 1)
    rows = (rows.withColumn("_m", F.explode(F.when(F.col("member"), own_part("mb")).otherwise(all_parts("mb"))))
            .withColumn("_v", F.explode(F.when(F.col("member"), all_parts("vb")).otherwise(own_part("vb")))).drop("mb", "vb"))

    def compare(group: pa.Table) -> pa.Table:
        member = group.column("member").to_numpy(zero_copy_only=False)
        pick = lambda mask: group.filter(pa.array(mask)).combine_chunks()
        here, there = pick(member), pick(~member)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not here.num_rows or not there.num_rows:
            return empty
        column = lambda t, c: t.column(c).to_numpy()
        vectors = lambda t: _unit(_matrix(t.column("vector").combine_chunks() if isinstance(t.column("vector"), pa.ChunkedArray) else t.column("vector"), dims))
        members, node, size = vectors(here), column(here, "node"), column(here, "n")
        seen = here.column("seen").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        label = {}
        found = {}

        def root(x: int) -> int:
            while label.setdefault(x, x) != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for start in range(0, there.num_rows, 1024):
            part = there.slice(start, 1024)
            other, other_size, own = column(part, "node"), column(part, "n"), column(part, "own")
            q, d = np.nonzero(vectors(part) @ members.T >= threshold)
            differ = other[q] != node[d]
            q, d = q[differ], d[differ]
            if not len(q):
                continue
            unseen = ~(seen[d] == own[q][:, None]).any(axis=1)     # the member will not come upon this visitor itself
            for who, what in ((other[q], size[d]), (node[d][unseen], other_size[q][unseen])):
                for a, n in zip(*_sums(who, what)):
                    found[a] = found.get(a, 0) + n
            for a, b in np.unique(np.stack([other[q], node[d]], axis=1), axis=0).tolist():
                x, y = root(a), root(b)
                if x != y:
                    label[max(x, y)] = min(x, y)
        stars = [(x, root(x)) for x in list(label) if root(x) != x]
        return pa.table({"a": pa.array([*found, *(x for x, _ in stars)], pa.int64()), "b": pa.array([None] * len(found) + [y for _, y in stars], pa.int64()),
                         "n": pa.array([*found.values()] + [0] * len(stars), pa.int64())})

    return rows.groupBy("cell", "_m", "_v").applyInArrow(compare, "a bigint, b bigint, n bigint")


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    names, place = np.unique(keys, return_inverse=True)
    return names.tolist(), np.bincount(place, weights=values, minlength=len(names)).astype(np.int64).tolist()


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, sample_rows: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors link where their cosine in double precision is ``threshold`` or
    more; equal vectors always do. Null, empty and zero vectors, such with null
    or non-finite components, and such of another length than most in the
    sample link with nothing. A pair counts if either side comes upon the
    other. The index is fitted on about ``sample_rows`` distinct vectors chosen by a
    hash; all are indexed and searched. Null ids stay null and are never the
    smallest; repeated rows are copies. Extra columns are ignored; an empty
    table gives an empty table.
    """
    values = F.col("embedding")
    digest = F.when(is_usable(values), F.sha2(values.cast("string"), 256))
    rows = cut(vectors.select("vec_id", digest.alias("digest"), values.alias("vector")))
    usable = rows.filter(F.col("digest").isNotNull())
    classes = usable.groupBy("digest").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    lengths = classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("k"), F.max("node").alias("_x"))
    top = lengths.orderBy(F.col("k").desc(), "d").first()
    ids = rows.select("vec_id", "digest")
    if top is None:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = top["d"]
    fitting = classes.filter(F.size("vector") == dims)
    share = min(1.0, sample_rows / top["k"])
    chosen = F.pmod(F.xxhash64("digest"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)) + 1)
    sample = fitting.filter(chosen).limit(2 * sample_rows).select("digest", "vector").toArrow().sort_by("digest")
    index = fit(_matrix(sample.column("vector").combine_chunks(), dims), top["k"], threshold, recall)
    found = cut(links(fitting, dims, index, threshold))
    degree = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_others"))
    reached = components(found.filter(F.col("b").isNotNull())).withColumnRenamed("node", "_node")
    marked = (classes.select("digest", "node", "n", "least").join(degree, "node", "left")
              .join(reached, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("label", F.coalesce("label", "node")))
    marked = cut(marked)
    roots = cut(marked.groupBy("label").agg(F.min("least").alias("_root")))
    by_class = marked.join(roots, "label").select("digest", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"), "_root")
    joined = ids.join(by_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("_root"))
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
