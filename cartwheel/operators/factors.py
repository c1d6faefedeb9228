"""Non-negative factorisation of who bought what, and the best articles by it without scoring all pairs.

The matrix is the sparse table of distinct pairs, the loss the squared error
over all cells, bought or not. With one side's factors fixed, the other side's
rows need only the sum of the factors they meet (one join and one aggregate)
and a square of the fixed side's products; each row is then a small
non-negative least squares problem of its own. Several ranks are fitted in the
same passes, their factors one behind the other in a row's array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cartwheel.functions.joins import skew_join
from cartwheel.functions.ranks import sorted_rank
from cartwheel.functions.stage import cut

# articles of the first group and of the largest one; a group is sent to all tasks
FIRST_GROUP, LARGEST_GROUP = 4_096, 65_536


def _parts(ranks: Sequence[int]) -> list[slice]:
    ends = np.cumsum([0, *ranks])
    return [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def solve_rows(sums: np.ndarray, gram: np.ndarray, sweeps: int = 2_000) -> np.ndarray:
    """Rows w >= 0 that minimise w G w' / 2 - s w', by coordinate descent over all rows at once, until nothing moves."""
    w = np.zeros_like(sums)
    scale = np.abs(sums).max(initial=0) / max(float(np.diag(gram).max(initial=0)), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(gram)):
            if gram[j, j] <= 0:
                continue
            after = np.maximum(0, w[:, j] + (sums[:, j] - w @ gram[:, j]) / gram[j, j])
            moved = max(moved, float(np.abs(after - w[:, j]).max(initial=0)))
            w[:, j] = after
        if moved <= 1e-13 * scale:
            break
    return w


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gram_of(factors: DataFrame, width: int) -> np.ndarray:
    """Products of the factors' columns, added up over all rows; a square of the ranks' width comes to the driver."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            f = _matrix(batch.column("f"), width)
            total += f.T @ f
        row, col = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(total.reshape(-1))], ["i", "j", "v"])

    found = np.zeros((width, width))
    for r in factors.select("f").mapInArrow(emit, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[r.i, r.j] = r.v
    return found


def first_factors(keys: DataFrame, key: str, ranks: Sequence[int], share: float, seed: int) -> DataFrame:
    """(key, f): repeatable random factors whose products are as large as the mean cell."""
    number = lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)), F.lit(1_000_003)).cast("double") / 1_000_003
    scale = [float(np.sqrt(share / rank)) * 2 for rank in ranks for _ in range(rank)]
    return keys.select(key, F.array(*[number(i) * F.lit(s) for i, s in enumerate(scale)]).alias("f"))


def _half_step(pairs: DataFrame, fixed: DataFrame, on: str, key: str, ranks: Sequence[int]) -> tuple[DataFrame, np.ndarray]:
    """(factors of ``key``, products of the fixed side)."""
    width = sum(ranks)
    gram = gram_of(fixed, width)
    met = skew_join(pairs, fixed, [on], "inner")
    sums = met.groupBy(key).agg(F.array(*[F.sum(F.col("f")[i]) for i in range(width)]).alias("s"))
    schema = T.StructType([pairs.schema[key], T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _matrix(batch.column("s"), width)
            f = np.concatenate([solve_rows(s[:, p], gram[p, p]) for p in _parts(ranks)], axis=1)
            offsets = pa.array(np.arange(0, f.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(f.reshape(-1))), batch.column("s")], [key, "f", "s"])

    return cut(sums.mapInArrow(emit, schema)), gram


def factorise(pairs: DataFrame, ranks: Sequence[int] = (2,), iterations: int = 10, seed: int = 42,
              tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, list[tuple[int, int, float]]]:
    """((customer_id, f), (article_id, f), [(rank, iteration, squared error)]) of distinct pairs (customer_id, article_id).

    ``f`` holds the factors of all ``ranks``, one rank behind the other. An
    iteration solves the customers' rows and then the articles'; the error is
    that after the customers' step and never rises. It ends early when no
    rank's error falls by more than ``tolerance`` of itself. Customers and
    articles without a pair have no factors. Pairs with nulls are left out.
    """
    pairs = cut(pairs.select("customer_id", "article_id").dropna().distinct())
    articles = cut(pairs.select("article_id").distinct())
    n, m, bought = pairs.select("customer_id").distinct().count(), articles.count(), pairs.count()
    if not bought:
        empty = pairs.withColumn("f", F.array().cast("array<double>"))
        return empty.select("customer_id", "f"), empty.select("article_id", "f"), []
    held = cut(first_factors(articles, "article_id", ranks, bought / n / m, seed))
    history: list[tuple[int, int, float]] = []
    width = sum(ranks)
    for iteration in range(iterations):
        rows, gram = _half_step(pairs, held, "article_id", "customer_id", ranks)
        own = gram_of(rows, width)
        products = F.array(*[F.sum(F.col("f")[i] * F.col("s")[i]) for i in range(width)]).alias("p")
        dots = np.array(rows.agg(products).first()[0])
        errors = [float(bought - 2 * dots[p].sum() + np.sum(own[p, p] * gram[p, p])) for p in _parts(ranks)]
        history += [(r, iteration, e) for r, e in zip(ranks, errors)]
        before = [e for _, i, e in history if i == iteration - 1]
        if iteration == iterations - 1 or before and all(b - e <= tolerance * b for b, e in zip(before, errors)):
            break
        held, _ = _half_step(pairs, rows, "customer_id", "article_id", ranks)
        held = held.select("article_id", "f")
    return rows.select("customer_id", "f"), held, history


def _group_of(place):
    """Groups double in size up to the largest."""
    doublings = int(np.log2(LARGEST_GROUP // FIRST_GROUP))
    growing = F.floor(F.log2(F.floor(place / FIRST_GROUP) + 1)).cast("int")
    start = FIRST_GROUP * (2 ** doublings - 1)
    return F.when(place < start, growing).otherwise((F.floor((place - start) / LARGEST_GROUP) + doublings).cast("int"))


def best_products(rows: DataFrame, items: DataFrame, n: int = 12) -> tuple[DataFrame, float]:
    """((customer_id, article_id, affinity, rank), share of all pairs that were scored): the ``n`` largest products of non-negative factors.

    Articles come by falling length of their factors, in groups. A customer
    who has ``n`` articles is done when nothing that is left can reach the
    last of them: neither the customer's length times the longest one left, nor
    the product with the largest entries left. Equal affinities go by article id.
    """
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x))
    placed = sorted_rank(items.select("article_id", "f", (-norm).alias("_short")), ["_short", "article_id"], "_place")
    grouped = cut(placed.withColumn("_group", _group_of(F.col("_place"))))
    width = grouped.select(F.max(F.size("f"))).first()[0] or 0
    # the longest and the largest entries of every group: a row per group of tens of thousands of articles
    tops = grouped.groupBy("_group").agg(F.max(-F.col("_short")).alias("norm"), F.count(F.lit(1)).alias("n"),
                                         F.array(*[F.max(F.col("f")[i]) for i in range(width)]).alias("f")).orderBy("_group").collect()
    schema = T.StructType([rows.schema["customer_id"], T.StructField("f", rows.schema["f"].dataType),
                           T.StructField("found", T.ArrayType(T.StructType([T.StructField("affinity", T.DoubleType()), items.schema["article_id"]])))])
    empty = F.array().cast(schema["found"].dataType)
    open_, done, scored, total = cut(rows.select("customer_id", "f", empty.alias("found"))), [], 0, 0
    waiting = open_.count()
    total = waiting * sum(t.n for t in tops)
    for at, top in enumerate(tops):
        if not waiting:
            break
        scored += waiting * top.n
        group = grouped.filter(F.col("_group") == top._group).select("article_id", "f").orderBy("article_id").toArrow()      # at most LARGEST_GROUP
        ids, matrix = group.column("article_id").to_pylist(), _matrix(group.column("f").combine_chunks(), width)
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))
        rest = tops[at + 1:]
        limit = (max(t.norm for t in rest), np.max([t.f for t in rest], axis=0)) if rest else None

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, factors = shared.value
            step = max(1, 4_000_000 // len(names))
            for batch in batches:
                for first in range(0, batch.num_rows, step):
                    part = batch.slice(first, step)
                    w = _matrix(part.column("f"), width)
                    scores = w @ factors.T
                    found, finished = [], []
                    for row, own, old in zip(scores, w, part.column("found").to_pylist()):
                        edge = np.partition(row, len(row) - n)[len(row) - n] if len(row) > n else -1.0
                        if len(old) >= n:
                            edge = max(edge, old[-1]["affinity"])
                        new = [{"affinity": float(row[i]), "article_id": names[i]} for i in np.flatnonzero(row >= edge).tolist()]
                        best = sorted(old + new, key=lambda a: (-a["affinity"], a["article_id"]))[:n]
                        found.append(best)
                        last = best[-1]["affinity"] if len(best) == n else -1.0
                        reach = -2.0 if limit is None else min(np.sqrt(own @ own) * limit[0], own @ limit[1]) * (1 + 1e-12)
                        finished.append(reach < last or limit is None)
                    yield pa.RecordBatch.from_arrays([part.column("customer_id"), part.column("f"), pa.array(found, part.schema.field("found").type),
                                                      pa.array(finished, pa.bool_())], ["customer_id", "f", "found", "finished"])

        step = cut(open_.mapInArrow(emit, T.StructType([*schema.fields, T.StructField("finished", T.BooleanType())])))
        done.append(step.filter("finished"))
        open_ = step.filter("NOT finished").drop("finished")
        waiting = open_.count()
    if not done:
        done = [open_]
    result = done[0].select("customer_id", "found")
    for more in done[1:]:
        result = result.unionByName(more.select("customer_id", "found"))
    flat = result.select("customer_id", F.posexplode("found").alias("_at", "_a"))
    return (flat.select("customer_id", "_a.article_id", "_a.affinity", (F.col("_at") + 1).cast("int").alias("rank")), scored / total if total else 0.0)


def factor_candidates(history: DataFrame, targets: DataFrame, n: int = 12, rank: int = 2, iterations: int = 10, seed: int = 42) -> DataFrame:
    """(customer_id, article_id, 1st_stage_rank): the ``n`` articles of the largest reconstructed cells per target that has bought anything."""
    rows, items, _ = factorise(history, (rank,), iterations, seed)
    wanted = rows.join(targets.select("customer_id").distinct(), "customer_id", "left_semi")
    best, _ = best_products(wanted, items, n)
    return best.select("customer_id", "article_id", (F.col("rank") - 1).cast("int").alias("1st_stage_rank"))
