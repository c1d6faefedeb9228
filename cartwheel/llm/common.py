"""Small helpers shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: words are runs of anything but ASCII white space
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def chunks(batches: Iterable[pa.RecordBatch], column: str, most_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts add up to about ``most_chars``, with the texts (null: empty).

    A single longer text is a slice of its own, so memory follows the longest
    text and not the number of rows Spark puts into a batch.
    """
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for at, text in enumerate(texts):
            if size and size + len(text) > most_chars:
                yield batch.slice(start, at - start), texts[start:at]
                start, size = at, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... ``sizes`` times for each entry."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
