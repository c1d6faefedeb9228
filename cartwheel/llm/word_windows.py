"""Removal of windows of words that occur before, through an index of words per shard.

A window of ``length`` words is judged by its anchor, the smallest hash among
the ``GRAM``-word strings in it, the leftmost if several are equal. Equal
windows have equal anchors at equal places, so work is dealt out by anchor. An
anchor owns the windows it is the smallest of; the words these span are its
segment.

* Equal texts are one text, the first of them; the others are gone as a whole.
* Equal segments of an anchor are one kind, whose first occurrence stays in
  question; all windows of the others occur before.
* The kinds of several anchors form a shard of about INDEX_WORDS words. An
  index over it finds, for each window streamed through it, the first of all
  occurrences.
* Kinds of an anchor with more than MOST_KINDS of them are cut again by the two
  smallest hashes of each window, then by the three smallest, and so on, and
  go through the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.ranks import sorted_rank
from cartwheel.functions.stage import cut, cut_by, discard
from cartwheel.llm.common import chunks, whole_text
from cartwheel.llm.fm_index import WordIndex

GRAM, INDEX_WORDS, MOST_KINDS, PART = 8, 250_000, 4_096, 1 << 20
_LAST_ID = 2 ** 63 - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True          # fixed values: ASCII white space
_rng = np.random.default_rng(12)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, more than ``n`` of each."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(21, int(n).bit_length())
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 2 ** 64))]
    return _powers[0], _powers[1]


def mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    value = value * np.uint64(0x9FB21C651E98DF25)
    return value ^ (value >> np.uint64(28))


def string_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], the same wherever the codes stand."""
    power, inverse = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:len(codes)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start])


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of some bytes, read in parts that end at white space."""
    codes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        stop = min(at + PART, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:          # a word goes on: to its end
            ahead = np.flatnonzero(_SPACE[data[stop:stop + PART]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + PART, len(data))
        part = data[at:stop]
        edge = np.diff(np.concatenate([[True], _SPACE[part], [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        codes.append(string_hashes(_BYTE[part], start, end))
        starts.append(start + at)
        at = stop
    return np.concatenate(codes), np.concatenate(starts)


def windows_of(codes: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that lie within one text; ``text`` numbers each word's."""
    if len(codes) < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(text[length - 1:] == text[:len(text) - length + 1])


def segments_of(codes: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, segment hash, first, last): the windows first to last have one anchor. Places count over all words given."""
    starts = windows_of(codes, text, length)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    gram = min(GRAM, length)
    span = length - gram + 1                            # strings in a window
    place = np.arange(len(codes) - gram + 1)
    hashes = string_hashes(codes, place, place + gram)
    owner = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), PART):              # the leftmost of the smallest
        some = starts[at:at + PART]
        least, where = hashes[some], some.copy()
        for step in range(1, span):
            other = hashes[some + step]
            less = other < least
            least = np.where(less, other, least)
            where = np.where(less, some + step, where)
        owner[at:at + PART] = where
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    return hashes[owner[head]], string_hashes(codes, first, last + length), first, last


def _texts_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, number of each word's text, first word of every text) of several texts at once."""
    codes, starts = word_codes(np.frombuffer(b"\n".join(raws), np.uint8))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    first = np.searchsorted(starts, bounds)
    return codes, np.repeat(np.arange(len(raws)), np.diff(first)), first


ANCHORS = "row bigint, anchor bigint, segment bigint, first int, last int"


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (p.split() for p in schema.split(", "))])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    named = _arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, named)], schema=named)


def find_anchors(texts: DataFrame, length: int) -> DataFrame:
    """ANCHORS of every text (row, text); first and last count the text's words."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in chunks(batches, "text"):
            codes, text, first_word = _texts_of([t.encode() for t in some])
            anchor, segment, first, last = segments_of(codes, text, length)
            of = text[first]
            yield _batch(ANCHORS, batch.column("row").to_numpy()[of], anchor.view(np.int64), segment.view(np.int64), (first - first_word[of]).astype(np.int32), (last - first_word[of]).astype(np.int32))

    return texts.select("row", "text").mapInArrow(emit, ANCHORS)


KINDS = "anchor bigint, row bigint, first int, data binary"


def _extracted(texts: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """KINDS: the words of each kind at its first occurrence; a text's kinds are bounded by its length."""
    wanted = kinds.join(texts.select("key", "row"), "row").groupBy("key").agg(F.first("row").alias("row"), F.collect_list(F.struct("anchor", "first", "last")).alias("want"))
    joined = texts.select("key", "text").join(wanted, "key").select("row", "text", "want")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in chunks(batches, "text"):
            found: list[list] = [[] for _ in range(4)]
            for text, row, want in zip(some, batch.column("row").to_pylist(), batch.column("want").to_pylist()):
                words = text.encode().split()           # at ASCII white space
                for w in want:
                    for column, value in zip(found, (w["anchor"], row, w["first"], b" ".join(words[w["first"]:w["last"] + length]))):
                        column.append(value)
            yield _batch(KINDS, *found)

    return joined.mapInArrow(emit, KINDS)


MARKS = "row bigint, low int, high int"


def _stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]


def judge_shard(kinds: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """MARKS of the windows of kinds (anchor, row, first, data) that occur before, in any kind of the shard."""
    numbers: dict[bytes, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in k[3].split(b" ")], np.int64) for k in kinds]
    # texts in their order, then the place in the text
    rows = {row: i for i, row in enumerate(sorted({k[1] for k in kinds}))}
    values = [(rows[k[1]] << 32) + k[2] + np.arange(len(t)) for k, t in zip(kinds, texts)]
    index = WordIndex(texts, values, len(numbers), length)
    found = []
    for kind, own, least in zip(kinds, values, index.matching_statistics(texts)[1]):
        before = np.flatnonzero(least < own)
        if len(before):
            found += [(kind[1], kind[2] + a, kind[2] + b) for a, b in zip(*(x.tolist() for x in _stretches(before)))]
    return found


def _judged(kinds: DataFrame, length: int) -> DataFrame:
    """MARKS by shards of whole anchors."""
    spread = kinds.repartition("anchor").sortWithinPartitions("anchor")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, previous = 0, None
        for batch in batches:
            for kind in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "first", "data"))):
                if size >= INDEX_WORDS and kind[0] != previous:
                    yield _batch(MARKS, *(list(zip(*judge_shard(held, length))) or [[], [], []]))
                    held, size = [], 0
                held.append(kind)
                size, previous = size + kind[3].count(b" ") + 2, kind[0]
        if held:
            yield _batch(MARKS, *(list(zip(*judge_shard(held, length))) or [[], [], []]))

    return spread.mapInArrow(emit, MARKS)


def _finer(kinds: DataFrame, length: int, level: int) -> DataFrame:
    """KINDS cut by the ``level`` smallest hashes of each window, under anchors made of these."""
    gram = min(GRAM, length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, firsts, raws = (part.column(c).to_pylist() for c in ("row", "first", "data"))
                codes, text, first_word = _texts_of(raws)
                place = np.arange(len(codes) - gram + 1)
                hashes = string_hashes(codes, place, place + gram)
                starts = windows_of(codes, text, length)
                least = np.sort(np.lib.stride_tricks.sliding_window_view(hashes, length - gram + 1)[starts], axis=1)[:, :level]
                key = np.zeros(len(starts), np.uint64)
                for column in least.T:
                    key = mixed(key * np.uint64(0xA24BAED4963EE407) + column)
                of = text[starts]
                head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
                tail = np.append(head[1:], len(starts)) - 1
                found: list[list] = [[] for _ in range(4)]
                split = [r.split(b" ") for r in raws]
                for h, t in zip(head.tolist(), tail.tolist()):
                    i = int(of[h])
                    a, b = int(starts[h] - first_word[i]), int(starts[t] - first_word[i])
                    for column, value in zip(found, (int(key[h].view(np.int64)), rows[i], firsts[i] + a, b" ".join(split[i][a:b + length]))):
                        column.append(value)
                yield _batch(KINDS, *found)

    return kinds.mapInArrow(emit, KINDS)


def _by_size(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds of anchors that one shard can hold, the others); the sizes are a table of their own, so that Spark can split hot anchors."""
    sizes = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 1))
    marked = cut(kinds.join(sizes, "anchor").withColumn("_many", F.col("_k") > MOST_KINDS).drop("_k"))
    return marked.filter(~F.col("_many")).drop("_many"), marked.filter("_many").drop("_many")


def _later(kinds: DataFrame, occurrences: DataFrame, on: list[str]) -> DataFrame:
    """Occurrences of a kind behind its first one."""
    several = cut(kinds.filter("_n > 1").select(*on, F.col("_at.row").alias("_row"), F.col("_at.first").alias("_first")))
    return occurrences.join(several, on).filter((F.col("row") != F.col("_row")) | (F.col("first") != F.col("_first")))


def find_windows(texts: DataFrame, length: int) -> DataFrame:
    """MARKS: all windows of the distinct texts (key, row, text) that occur before; ``row`` is a text's place in their order."""
    anchors = cut(find_anchors(texts, length), "zstd")
    seen = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("anchor"))
    again = cut(anchors.join(seen, "anchor"), "zstd")
    discard(anchors)
    kinds = cut(again.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "first", "last")).alias("_at")))
    marks = [_later(kinds, again, ["anchor", "segment"]).select("row", F.col("first").alias("low"), F.col("last").alias("high"))]
    calm, hot = _by_size(kinds.select("anchor", "_at.*"))
    marks.append(_judged(_extracted(texts, calm, length), length))
    hot = cut(_extracted(texts, hot, length))
    level, most = 1, length - min(GRAM, length) + 1
    while not hot.isEmpty():
        level += 1
        parts = cut(_finer(hot, length, level))
        kinds = cut(parts.groupBy("anchor", "data").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "first")).alias("_at")))
        words = F.size(F.split(F.col("data").cast("string"), " "))
        marks.append(_later(kinds, parts, ["anchor", "data"]).select("row", F.col("first").alias("low"), (F.col("first") + words - length).alias("high")))
        kinds = kinds.select("anchor", "_at.*", "data")
        if level == most:           # all hashes of the windows are equal
            marks.append(_judged(kinds, length))
            break
        calm, hot = _by_size(kinds)
        marks.append(_judged(calm, length))
    result = marks[0]
    for more in marks[1:]:
        result = result.unionByName(more)
    return result


DONE = "key binary, _first bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def remove_windows(docs: DataFrame, length: int = 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 [, kept]), one row per input row.

    Words are runs of anything but ASCII white space. Each word goes that a
    window of ``length`` words covers whose words also start earlier: in a row
    with a smaller id (null ids come last, rows of one id in the order they are
    read), or in the same row at an earlier place. Windows are judged on the
    input. ``kept`` are the words left, joined by blanks.

    Null texts are empty; texts of fewer words lose nothing; of rows with equal
    texts all but the first lose every word from ``length`` words on. Extra
    columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("string").alias("text"))
    keyed = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.md5("text")).alias("key")))
    first = keyed.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), "row")).alias("_at")).select("key", "_at.*")
    placed = sorted_rank(first, ["id", "row"], "place").select("key", F.col("row").alias("_first"), F.col("place").alias("row"))
    # one shuffle of the texts; what is found about them later comes to their buckets
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.select(F.unhex(F.md5("text")).alias("key"), "text").repartition(buckets, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = cut_by(whole.join(placed, "key"), "key", buckets=buckets, codec="zstd")
    marks = find_windows(texts, length).join(texts.select("key", "row"), "row").groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    schema = DONE + (", kept string" if keep_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in chunks(batches, "text"):
            found: list[list] = [[] for _ in schema.split(", ")]
            for text, key, row, spans in zip(some, *(batch.column(c).to_pylist() for c in ("key", "_first", "spans"))):
                words = text.encode().split()
                left = words
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["low"] for s in spans], 1)
                    np.add.at(change, [s["high"] + length for s in spans], -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept = b" ".join(left)
                for column, value in zip(found, (key, row, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    column.append(value)
            yield _batch(schema, *found)

    done = cut(texts.join(marks, "key", "left").select("key", "_first", "text", "spans").mapInArrow(apply, schema))
    copy = (F.col("row") != F.col("_first")) & (F.col("n_words") >= length)
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
               F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    columns += [F.when(copy, "").otherwise(F.col("kept")).alias("kept")] if keep_text else []
    return keyed.join(done, "key").select(*columns)
