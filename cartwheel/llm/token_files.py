"""Token ids in files: frequency-ranked codes of one to four bytes with separate control bytes.

Ids are replaced by their rank in frequency order, so that the commonest 256
take one byte. A control byte holds the lengths of four codes, two bits each,
first code lowest; control and data are two streams. A file table has one row
per block of documents:

    shard int, block int, first bigint, doc_ids array, n_tokens array<bigint>, control binary, data binary

Each document's control bytes start on a byte of their own. ``shard`` counts
ranges of doc_id in ascending order, ``block`` the blocks of a range and
``first`` the ids before the block in its range. The dictionary (code -> id) is a table beside it. Spark's writers commit the files,
so a task that runs twice leaves one copy, in any store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cartwheel.functions.stage import stage_path
from cartwheel.llm.common import chunks, spread
from cartwheel.llm.wordmemo import library_codes

BLOCK_BYTES = 4_000_000
# texts encoded together, and words a worker remembers: both bound its memory and change no id
CHUNK_CHARS = 6_000_000
WORDS = 800_000
# lengths of the four codes of every control byte, and their offsets from the group's first byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def pack_all(codes: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of consecutive runs of ``counts`` codes; a run's control bytes are its own."""
    sizes = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    groups = np.append(0, np.cumsum(-(-counts // 4)))
    padded = np.zeros(groups[-1] * 4, np.uint8)
    padded[spread(4 * groups[:-1], counts)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4)[None, :] < sizes[:, None]].tobytes()
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))[np.append(0, np.cumsum(counts))].tolist()
    groups = groups.tolist()
    return [control[a:b] for a, b in zip(groups, groups[1:])], [data[a:b] for a, b in zip(ends, ends[1:])]


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    control, data = pack_all(codes, np.array([len(codes)]))
    return control[0], data[0]


def unpack(control: bytes, data: bytes, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` codes that start the streams, and the number of data bytes they take."""
    if not n:
        return np.zeros(0, np.uint32), 0
    sizes = LENGTHS[np.frombuffer(control, np.uint8, -(-n // 4))].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    used = int(sizes.sum())
    raw = np.zeros(used + 4, np.uint32)
    raw[:used] = np.frombuffer(data, np.uint8, used)
    codes = raw[starts].copy()
    for byte in (1, 2, 3):
        codes |= np.where(sizes > byte, raw[starts + byte] << np.uint32(8 * byte), np.uint32(0))
    return codes, used


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary): little-endian ids of 2 bytes, 4 where a vocabulary needs them, with the end id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = library_codes(tokenizer_path, WORDS)
        kind = id_type(len(codes.ends))
        for batch, texts in chunks(batches, "text", CHUNK_CHARS):
            ids = [np.append(np.frombuffer(c, "<u4"), np.uint32(end_id)).astype(kind).tobytes() for c in codes.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(encode, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def frequencies(encoded: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n) over all documents; a task sends a row per id at most."""
    kind = id_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                joined = b"".join(batch.column("ids").slice(start, 512).to_pylist())
                total += np.bincount(np.frombuffer(joined, kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write ``folder``/tokens and ``folder``/codes.

    Documents are in ascending id order, null ids first; documents with one id
    go by their ids' bytes. Extra columns are ignored; an empty table writes empty tables.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values()]) + 1
    kind = id_type(vocabulary)
    staged = stage_path(spark, "ids")
    encoded = encode_ids(docs, tokenizer_path, end_id)
    encoded.write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.schema(encoded.schema).parquet(staged)
    order = Window.orderBy(F.col("n").desc(), "id")             # at most one row per id of the vocabulary
    codes = frequencies(encoded, vocabulary).select((F.row_number().over(order) - 1).alias("code"), "id")
    codes.write.parquet(f"{folder}/codes")
    ranked = spark.read.schema("code int, id bigint").parquet(f"{folder}/codes").toPandas()
    code_of = np.zeros(vocabulary, np.uint32)
    code_of[ranked["id"].to_numpy()] = ranked["code"].to_numpy()

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("ids").to_pylist()
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
                control, data = pack_all(code_of[np.frombuffer(b"".join(ids), kind)], counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["doc_id", "n", "control", "data"])

    doc_kind = encoded.schema["doc_id"].dataType.simpleString()
    # ranges are found on the stored ids, so that nothing is coded twice for the sake of their bounds
    ranged = encoded.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, size, first = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            ids, ns, controls, datas = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([list(ids)], pa.list_(id_kind)),
                 pa.array([list(ns)], pa.list_(pa.int64())), pa.array([b"".join(controls)], pa.binary()), pa.array([b"".join(datas)], pa.binary())],
                ["shard", "block", "first", "doc_ids", "n_tokens", "control", "data"])

        for batch in recode(batches):
            id_kind = batch.schema.field("doc_id").type
            for one in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(one)
                size += len(one[2]) + len(one[3])
                if size >= BLOCK_BYTES:
                    yield row()
                    first += sum(one[1] for one in held)
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    schema = f"shard int, block int, first bigint, doc_ids array<{doc_kind}>, n_tokens array<bigint>, control binary, data binary"
    ranged.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{folder}/tokens")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) from the files; ``start`` counts the ids of all documents before."""
    return _read(spark, folder, "ids array<int>", lambda ids: pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    import zlib

    return _read(spark, folder, "ids_crc32 bigint", lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()))


def _read(spark: SparkSession, folder: str, column: str, value) -> DataFrame:
    ranked = spark.read.schema("code int, id bigint").parquet(f"{folder}/codes").toPandas()   # bounded by the vocabulary
    id_of = np.zeros(len(ranked) + 1, np.uint32)
    id_of[ranked["code"].to_numpy()] = ranked["id"].to_numpy()
    files = spark.read.parquet(f"{folder}/tokens")
    doc_kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    total = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n)
    shards = files.groupBy("shard").agg(F.sum(total).alias("_n"))               # one row per writing task
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    name = column.split()[0]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, counts, control, data, first = [batch.column(c)[i] for c in ("doc_ids", "n_tokens", "control", "data", "first")]
                counts, control, data = counts.values.to_numpy(), control.as_py(), data.as_py()
                starts = first.as_py() + np.cumsum(counts) - counts
                at = used = 0
                ids = []
                for n in counts.tolist():
                    codes, bytes_used = unpack(memoryview(control)[at:], memoryview(data)[used:], n)
                    ids.append(id_of[codes])
                    at, used = at + -(-n // 4), used + bytes_used
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), value(ids)],
                    ["doc_id", "start", "n_tokens", name])

    placed = files.join(F.broadcast(shards), "shard").withColumn("first", F.col("_before") + F.col("first"))
    return placed.select("doc_ids", "n_tokens", "control", "data", "first").mapInArrow(
        decode, f"doc_id {doc_kind}, start bigint, n_tokens bigint, {column}")
