"""A corpus pipeline over documents: toxic texts, near copies, personal data, source weights, byte pairs.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of documents; the last returns the encoded mix. Stages
are written as parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm import bpe, mixing, pii, simhash, toxicity
from cartwheel.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score reaches their language's threshold. The network learns from the stage's own input.

    Null texts are scored as empty, null languages by the threshold of all;
    rows of one id are judged one by one. Extra columns leave.
    """
    judged = toxicity.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.filter(F.col("score") < F.col("threshold")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id, null last, and then by its content.

    A row's key is its id with a digest of all columns, so rows of one key are
    equal and any of them will do. Keys with several rows have a join of their
    own, in which equal rows become one; all others meet their key once.
    """
    content = [F.sha2("text", 256).alias("text"), *[F.col(c) for c in COLUMNS if c not in ("doc_id", "text")]]
    keyed = docs.select(*COLUMNS, F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", F.unhex(F.sha2(F.to_json(F.struct(*content)), 256)).alias("digest")).alias("_key"))
    marks = simhash.near_copies(keyed.select(F.col("_key").alias("doc_id"), "text"))
    kept = marks.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    kept = cut(kept)
    several = cut(kept.filter("n > 1").select("_key"))       # a table of its own: Spark sees that it is small, and sends no text to meet it
    one = keyed.join(kept.filter("n = 1").select("_key"), "_key", "left_semi")
    equal = keyed.join(several, "_key", "left_semi").groupBy("_key").agg(*[F.first(c).alias(c) for c in COLUMNS])
    return one.select(*COLUMNS).unionByName(equal.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of each span of personal data in its place; ``n_chars`` follows the text.

    Null texts stay null, and every row stays; extra columns leave.
    """
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source weight: some leave, some come twice.

    Null sources are one source; texts without a word, null ones too, have no
    size and leave; rows of one id or text are documents of their own. Extra
    columns leave, whatever their names.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), whole=True, keep=["text", "lang", "n_chars"])
    return mixed.filter(F.col("words") > 0).select(*COLUMNS)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded mix: each row's ids, with digests of the ids and of the bytes they decode to.

    Null and empty texts have no ids; rows of one id or text have a row each.
    """
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_checked(docs, path, pattern)


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_copies", near_copies),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_pairs),
]
# a trained network and merges have no SQL form; the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
