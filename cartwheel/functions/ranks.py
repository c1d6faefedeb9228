"""Ranking helpers that stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.stage import cut

# 2^16 hash buckets: the offset table has at most 65,536 rows, whatever the data size
_BUCKET_SHIFT = 16


def top_n(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per key, with a 1-based rank.

    Written as row_number + filter so that Spark puts a partial group limit
    below the shuffle: at most ``n`` rows per key leave each map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)


def best_row(frame: DataFrame, keys: Sequence[str], order: Sequence[Column],
             values: Sequence[str]) -> DataFrame:
    """The first row per key as an aggregate, so map tasks pre-combine hot keys.

    ``order`` holds expressions to be minimised (negate counts for descending).
    """
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *values)
    return (frame.groupBy(*keys).agg(F.min(packed).alias("_best"))
            .select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values]))


def ordered_list(frame: DataFrame, n: int, order: Sequence[Column], columns: Sequence[str],
                 rank_col: str = "rank") -> DataFrame:
    """Global first ``n`` rows with a 1-based rank. ``n`` is a report-sized limit.

    The limit runs as TakeOrderedAndProject; the rank comes from the position
    in an array of at most ``n`` entries.
    """
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns)
    top = frame.select(packed.alias("_row")).orderBy("_row").limit(n)
    rows = top.agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return (rows.select(F.posexplode("_rows").alias("_pos", "_row"))
            .select(*[F.col(f"_row.{c}").alias(c) for c in columns],
                    (F.col("_pos") + 1).cast("int").alias(rank_col)))


def md5_int(seed: int | Column, *columns: str | Column) -> Column:
    """A repeatable 32-bit number from a seed and key columns.

    Same value on every run and on every retry of a task, unlike rand().
    """
    seed_col = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [c if isinstance(c, Column) else F.col(c) for c in columns]
    text = F.concat_ws("|", seed_col, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_rank(frame: DataFrame, keys: Sequence[str], seed: int, rank_col: str) -> DataFrame:
    """Dense 1-based rank of every row in md5 order, ties by ``keys``.

    A global row_number would sort everything in one task. Here rows are
    spread over hash buckets; only the per-bucket counts (at most 65,536 rows)
    are accumulated in one place and sent back as offsets.
    """
    hashed = (frame.withColumn("_h", md5_int(seed, *keys))
              .withColumn("_b", F.shiftright("_h", _BUCKET_SHIFT)))
    offsets = (hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_off", F.sum("_c").over(
                   Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
               .select("_b", F.coalesce("_off", F.lit(0)).alias("_off")))
    within = Window.partitionBy("_b").orderBy("_h", *keys)
    return (hashed.withColumn("_r", F.row_number().over(within))
            .join(F.broadcast(offsets), "_b")
            .withColumn(rank_col, F.col("_r") + F.col("_off"))
            .drop("_h", "_b", "_r", "_off"))


def sorted_rank(frame: DataFrame, order: Sequence[str], rank_col: str) -> DataFrame:
    """0-based position of every row in the order of ``order``, which must be unique.

    Rows are range-partitioned and numbered inside their partition, and the
    result is kept as a table, so that the partition bounds cannot move
    afterwards. Only one count per partition is accumulated in one place.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    # the id holds the partition in its upper bits and the position in the lower 33
    placed = (placed.withColumn("_part", F.shiftright("_m", 33))
              .withColumn("_pos", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_off", F.coalesce(F.sum("_c").over(
                   Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_part", "_off"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(rank_col, F.col("_off") + F.col("_pos")).drop("_m", "_part", "_pos", "_off"))


def running_sum(frame: DataFrame, order: Sequence[str], weight: str, out: str) -> DataFrame:
    """Sum of ``weight`` over all rows up to and including each, in the order of ``order``, which must be unique.

    Rows are range-partitioned by their own distribution, so far outliers do
    not crowd the rest into few tasks; only one sum per range is accumulated in
    one place.
    """
    ranged = cut(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = (ranged.groupBy("_part").agg(F.sum(weight).alias("_s"))
              .withColumn("_off", F.coalesce(F.sum("_s").over(
                  Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("_part", "_off"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.withColumn(out, F.sum(weight).over(within)).join(F.broadcast(totals), "_part")
            .withColumn(out, F.col(out) + F.col("_off")).drop("_part", "_off"))


def smallest_by_hash(frame: DataFrame, group: str, keys: Sequence[str], hash_col: str,
                     quota: DataFrame) -> DataFrame:
    """Exactly ``quota.n`` rows per group, taken in ``hash_col`` order (ties by keys).

    ``quota`` has one row (group, n) per group and must be small (seeds of a
    bagging run). Only rows of the one bucket in which the quota runs out are
    sorted; all lower buckets pass a filter without a shuffle.
    """
    bucketed = frame.withColumn("_b", F.shiftright(hash_col, _BUCKET_SHIFT))
    running = (bucketed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_cum", F.sum("_c").over(
                   Window.partitionBy(group).orderBy("_b")
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    cut = (quota.join(running, group, "left")
           .groupBy(group, "n")
           .agg(F.min(F.when(F.col("_cum") >= F.col("n"), F.struct("_b", "_cum", "_c"))).alias("_cut"))
           .select(group, F.coalesce(F.col("_cut._b"), F.lit(1 << 32)).alias("_edge"),
                   (F.col("n") - F.col("_cut._cum") + F.col("_cut._c")).alias("_left")))
    marked = bucketed.join(F.broadcast(cut), group)
    below = marked.filter(F.col("_b") < F.col("_edge"))
    at = marked.filter(F.col("_b") == F.col("_edge"))
    order = Window.partitionBy(group).orderBy(hash_col, *keys)
    at = (at.withColumn("_r", F.row_number().over(order))
          .filter(F.col("_r") <= F.col("_left")).drop("_r"))
    return below.unionByName(at).drop("_b", "_edge", "_left")
