"""CSV and parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def all_strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             columns: Sequence[str] | None = None) -> DataFrame:
    """Read a headed CSV by column name: forced types, optional column subset.

    The file may hold its columns in any order and may hold others besides;
    everything is read as text and cast, so leading zeros of ids survive.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_stage(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage table to shared storage and continue from the written files."""
    frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return frame.sparkSession.read.parquet(path)


def write_facts(transactions: DataFrame, path: str, files_per_month: int | None = None) -> DataFrame:
    """Facts partitioned by month, so that date filters prune whole folders.

    Rows are spread over (month, hash of the pair) before the write: one month
    goes to ``files_per_month`` tasks, also if it holds most of the rows.
    """
    spark = transactions.sparkSession
    parts = files_per_month or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("customer_id", "article_id"), F.lit(parts))
    frame = transactions.withColumn("month", F.date_format("t_dat", "yyyy-MM")).repartition("month", spread)
    frame.write.mode("overwrite").partitionBy("month").parquet(path)
    return spark.read.parquet(path)


def read_facts_since(spark: SparkSession, path: str, first_day: str) -> DataFrame:
    """Facts from ``first_day`` on; the month predicate prunes partitions."""
    return (spark.read.parquet(path)
            .filter((F.col("month") >= first_day[:7]) & (F.col("t_dat") >= F.lit(first_day).cast("date")))
            .drop("month"))


def read_tagged(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """One frame over the files of several experiments, tagged with ``exp``."""
    result = None
    for name, path in paths.items():
        part = read_csv(spark, path, schema).withColumn("exp", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result
