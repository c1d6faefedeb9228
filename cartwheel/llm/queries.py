"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartwheel.functions.stage import stage_path
from cartwheel.llm import alignment, bpe, mixing, pii, quality, repeats, simhash, token_counts, token_files, toxicity, vectors, whitening, word_windows
from cartwheel.llm.common import table
from cartwheel.llm.sql import SQL  # noqa: F401  (registered beside the queries)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(table(spark, folder, "documents"), path, pattern)
    return bpe.round_trip_digests(encoded, path, pattern)


def op3_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, folder, "documents"), numbered=True))


def op4_long_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = stage_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), files)
    return token_files.read_checksums(spark, files)


def op6_simhash_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_word_windows(spark: SparkSession, folder: str) -> DataFrame:
    return word_windows.remove_windows(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_byte_bpe, op3_mixed_sources, op4_long_repeats, op5_token_files, op6_simhash_near_copies, op7_quality_rules,
    op8_near_vectors, op9_toxicity, op10_personal_data, op11_whitening, op12_word_windows, op13_token_alignment)}
