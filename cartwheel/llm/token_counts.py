"""Token counts through a digest cache.

The cache is a table (version, digest, n_tokens). ``version`` is the digest of
the tokenizer file, ``digest`` that of the normalised content (null as empty;
the tokenizer sees the rest as it is, since any other change could change its
tokens). Known contents are a join; only distinct misses are encoded, and what
they give is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwheel.functions.stage import cut, stage_path
from cartwheel.llm.common import chunks, whole_text
from cartwheel.llm.wordmemo import library_codes

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One row per digest. A lost and repeated append may have stored a digest twice, with the same count."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(f"{cache}/version={version}")
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row, extra columns ignored.

    ``cache`` is a folder shared by the executors; without one a new one is
    used. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and
    repeated ids each keep a row; a null id stays null. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache = cache or stage_path(spark, "tokens")
    keyed = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    folder = f"{cache}/version={version}"
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(folder)

    # copies meet in the map tasks first, so a text that a third of the rows share costs a row per task
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = library_codes(tokenizer_path)
        for batch, texts in chunks(batches, "text"):
            counts = [len(c) // 4 for c in codes.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(folder)
    counted = keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    known = cut(read_cache(spark, cache, version))       # a table, so that Spark can split a digest with very many rows
    return (counted.join(known, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
