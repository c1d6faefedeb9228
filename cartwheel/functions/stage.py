"""Cutting lineage through shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# fixed value: whether Spark deletes an execution's shuffle files when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder name for intermediate data, deleted when the session's JVM ends."""
    path = f"{checkpoint_folder(spark)}/cartwheel/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop_path)
    return path


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(frame: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``frame`` as a parquet table in the shared folder and go on from the files.

    Later steps read it instead of computing it again, a lost executor costs a
    re-read, and Spark knows its size, which decides about broadcasts. The
    shuffle files behind the table are deleted with the end of the write.
    """
    spark = frame.sparkSession
    path = stage_path(spark)
    with _without_leftovers(spark):
        frame.write.option("compression", codec).parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.stage_folder = path
    return stored


def cut_by(frame: DataFrame, *keys: str, buckets: int | None = None, codec: str = "snappy") -> DataFrame:
    """As ``cut``, with the rows of a key in one bucket of the table.

    Joins and aggregates on the keys read buckets side by side: only the other
    side of a join is shuffled. There are as many buckets as the session has
    shuffle partitions unless told, and a file for each.
    """
    spark = frame.sparkSession
    path, name = stage_path(spark), f"stage_{uuid.uuid4().hex}"
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartition(count, *keys)
    with _without_leftovers(spark):
        (dealt.write.format("parquet").option("compression", codec).option("path", path)
         .bucketBy(count, *keys).sortBy(*keys).saveAsTable(name))
    stored = spark.table(name)
    stored.stage_folder, stored.stage_table = path, name
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a stage table whose readers have all been written."""
    spark = stored.sparkSession
    if hasattr(stored, "stage_table"):
        spark.sql(f"DROP TABLE IF EXISTS {stored.stage_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stage_folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
