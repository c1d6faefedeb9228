"""Removal of long strings that occur more than once in the corpus, through run-length indexes.

A string of ``length`` bytes is judged by its anchor, the smallest hash among
the ``GRAM``-byte strings in it. Equal strings have equal anchors at equal
places, so work is dealt out by anchor. An anchor owns the starts of the
strings it is the smallest of; the bytes these strings span are its segment.

* Anchors seen once drop out. Where all segments of an anchor are the same
  text, they are one segment with a count, and its strings repeat if the count
  is two or more.
* The distinct segments of the other anchors form texts of about
  ``INDEX_BYTES``. Each text gets a run-compressed Burrows-Wheeler transform
  with the text positions and the longest common prefixes at the ends of its
  runs alone. Streaming over the text, the matching statistics of all other
  positions follow from the last sample (one less for each byte), and matches
  of ``length`` bytes or more are marked.
* An anchor with more than ``GROUP`` distinct segments would not be one task's
  work. Its strings are counted one by one by hash, with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.common import whole_text

GRAM, GROUP, INDEX_BYTES, BUFFER = 96, 2048, 1_000_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` + 1 of each."""
    size = max(1 << 21, 1 << (n + 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.ones(size, np.uint64)
            table[1:] = np.uint64(base)
            tables.append(np.multiply.accumulate(table))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def _prefix_hashes(data: np.ndarray, byte_codes: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes[data] * power[:len(data)], out=sums[1:])
    return sums


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    _, inverse = _power_tables(len(sums))
    value = (sums[end] - sums[start]) * inverse[start]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first, last, place) of one text of at least ``length`` bytes.

    ``first`` and ``last`` are the owned string starts, ``place`` the anchor's.
    Strings are read ``BUFFER`` starts at a time, with the bytes that the last
    of them needs, so the arrays do not grow with the text; an anchor's starts
    on both sides of a seam are one range.
    """
    gram = min(GRAM, length)
    n = len(data) - length + 1
    parts = [_owners(data, start, min(start + BUFFER, n), length, gram) for start in range(0, n, BUFFER)]
    first, last, at, hashes = (np.concatenate(c) for c in zip(*[p[:4] for p in parts]))
    segments = np.concatenate([p[4] for p in parts])
    new = np.append(True, at[1:] != at[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    segments = segments[heads]
    for i in np.flatnonzero(heads != tails).tolist():
        whole = data[first[heads[i]]:last[tails[i]] + length]
        segments[i] = _between(_prefix_hashes(whole, _BYTE), np.array([0]), np.array([len(whole)]))[0]
    return hashes[heads], segments, first[heads], last[tails], at[heads]


def _owners(data: np.ndarray, start: int, end: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first, last, place, anchor hash, segment hash) of the string starts from ``start`` to ``end``, places in the whole text."""
    span = length - gram + 1                            # gram places in a string
    part = data[start:end + length - 1]
    sums = _prefix_hashes(part, _BYTE)
    place = np.arange(len(part) - gram + 1)
    hashes = _between(sums, place, place + gram)
    # the smallest of span neighbours, the leftmost among equals: hash bits above place bits, minima over doubled widths
    low_bits = np.uint64(max(1, int(len(data)).bit_length()))
    best = (hashes >> low_bits << low_bits) | (place + start).astype(np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        rest = span - width
        best = np.minimum(best[:-rest], best[rest:])
    owner = (best & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    return first + start, last + start, at, hashes[at - start], _between(sums, first, last + length)


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, anchor, segment, first, last): one row per anchor of every text; ``key`` is the text's md5."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                columns: list[list] = [[], [], [], [], []]
                for text in batch.column("text").slice(start, 64).to_pylist():
                    raw = (text or "").encode()
                    if len(raw) < length:
                        continue
                    hashes, segments, first, last, _ = anchors_of(np.frombuffer(raw, np.uint8), length)
                    for column, values in zip(columns, ([hashlib.md5(raw).digest()] * len(hashes), hashes.view(np.int64), segments.view(np.int64), first, last)):
                        column.append(values)
                if columns[0]:
                    keys = [k for part in columns[0] for k in part]
                    rest = [np.concatenate(c) for c in columns[1:]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2].astype(np.int32)), pa.array(rest[3].astype(np.int32))],
                        ["key", "anchor", "segment", "first", "last"])

    return docs.select("text").mapInArrow(emit, "key binary, anchor bigint, segment bigint, first int, last int")


# ---- the run-length index -------------------------------------------------------------

def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes, by doubling from words of seven bytes."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    word = np.zeros(n, np.uint64)
    for i in range(7):
        word = (word << np.uint64(9)) | padded[i:i + n]
    order = np.argsort(word)
    changes = np.append(True, word[order[1:]] != word[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(changes)
    step = 7
    while rank[order[-1]] < n:
        second = np.zeros(n, np.int64)
        if step < n:
            second[:-step] = rank[step:]
        # suffixes that are alone in their class keep their place
        counts = np.bincount(rank, minlength=n + 2)
        open_ = np.flatnonzero(counts[rank] > 1)
        pair = rank[open_] * (n + 1) + second[open_]
        sub = np.argsort(pair)
        chosen, pair = open_[sub], pair[sub]
        first_place = np.cumsum(np.append(0, counts))[:-1]             # of each class, in sorted order
        head = np.append(True, rank[chosen[1:]] != rank[chosen[:-1]])
        run_start = np.maximum.accumulate(np.where(head, np.arange(len(chosen)), 0))
        slot = first_place[rank[chosen]] + np.arange(len(chosen)) - run_start
        order[slot] = chosen
        fresh = np.append(True, pair[1:] != pair[:-1])
        new_rank = np.maximum.accumulate(np.where(fresh, slot, 0))
        rank = _dense(rank, order, chosen, new_rank)
        step *= 2
    return order


def _dense(rank: np.ndarray, order: np.ndarray, chosen: np.ndarray, new_rank: np.ndarray) -> np.ndarray:
    """Ranks 1, 2, ... after the members of open classes got new first slots."""
    slots = np.empty(len(rank), np.int64)
    slots[order] = np.arange(len(rank))
    first = slots.copy()
    first[chosen] = new_rank
    change = np.zeros(len(rank), bool)
    change[first] = True
    return np.cumsum(change)[first]


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text, with samples at both ends of every run.

    ``heads`` and ``tails`` hold, by text position, the common prefix with the
    suffix sorted before (at run heads) and after (at run ends).
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        last = text[order - 1].astype(np.int16)
        last[order == 0] = -1
        edge = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        self.run_start, self.run_byte = edge, last[edge]
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
        self.words = np.ascontiguousarray(words).view("<u8").reshape(-1)
        self.n = len(text)
        heads, ends = edge[edge > 0], np.append(edge[1:], len(order)) - 1
        ends = ends[ends < len(order) - 1]
        self.heads = self._samples(order[heads], order[heads - 1], order[0])
        self.tails = self._samples(order[ends], order[ends + 1], order[-1])

    def _samples(self, here: np.ndarray, there: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(here, alone)                     # the first and the last suffix lack one neighbour
        value = np.append(self._common(here, there), 0)
        order = np.argsort(at)
        return at[order], value[order]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes, eight bytes a step."""
        found = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_] + found[open_], b[open_] + found[open_]
            ok = (x < self.n) & (y < self.n)
            differ = np.where(ok, self.words[np.minimum(x, self.n)] ^ self.words[np.minimum(y, self.n)], np.uint64(1))
            same = differ == 0
            lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            found[open_] += np.where(same, 8, np.where(ok, lowest, 0))
            open_ = open_[same]
        return np.minimum(found, self.n - np.maximum(a, b))

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match of every position with any other, from the samples alone."""
        best = np.zeros(self.n, np.int64)
        for at, value in (self.heads, self.tails):
            sample = np.zeros(self.n, np.int64)
            sample[at] = np.arange(len(at))
            sample = np.maximum.accumulate(sample)
            np.maximum(best, value[sample] - (np.arange(self.n) - at[sample]), out=best)
        return best


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the starts whose ``length`` bytes occur elsewhere in the segments."""
    # every segment ends with a mark of its own, of bytes that UTF-8 does not use, so no match goes on into the next
    digits = lambda i: bytes(0xF8 + i // 7 ** d % 7 for d in range(6))
    marked = [s + b"\xff" + digits(i) for i, s in enumerate(segments)]
    text = np.frombuffer(b"".join(marked), np.uint8)
    matches = RunIndex(text).matching_statistics()
    starts = np.cumsum([0, *map(len, marked)])
    return [np.flatnonzero(matches[a:a + max(0, len(s) - length + 1)] >= length) for s, a in zip(segments, starts.tolist())]


def as_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]


def _extracted(texts: DataFrame, wanted: DataFrame, length: int, schema: str, emit_rows) -> DataFrame:
    """Rows made of the wanted segments of every text (key, text); a text's segments are bounded by its length."""
    by_key = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "first", "last", "n")).alias("want"))
    joined = texts.join(by_key, "key").select("text", "want")
    names = [part.split()[0] for part in schema.split(", ")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                part = batch.slice(start, 32)
                rows = []
                for text, want in zip(part.column("text").to_pylist(), part.column("want").to_pylist()):
                    raw = text.encode()
                    for w in want:
                        rows.extend(emit_rows(w, raw[w["first"]:w["last"] + length]))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow_schema(schema))

    return joined.mapInArrow(extract, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in schema.split(", ")])


RUNS = "anchor bigint, segment bigint, low int, high int"


def _indexed(segments: DataFrame, length: int) -> DataFrame:
    """RUNS of the repeated starts in segments (anchor, segment, n, data), an index for about INDEX_BYTES of whole anchors."""
    spread = segments.repartition("anchor").sortWithinPartitions("anchor", "segment")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, previous = 0, None

        def mark() -> pa.RecordBatch:
            found = []
            for (anchor, segment, n, data), starts in zip(held, repeated_starts([h[3] for h in held], length)):
                if n > 1:                               # the segment itself stands elsewhere
                    starts = np.arange(len(data) - length + 1)
                if len(starts):
                    found += [(anchor, segment, a, b) for a, b in zip(*(x.tolist() for x in as_runs(starts)))]
            columns = list(zip(*found)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow_schema(RUNS))], schema=_arrow_schema(RUNS))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "segment", "n", "data")]):
                if size >= INDEX_BYTES and row[0] != previous:
                    yield mark()
                    held, size = [], 0
                held.append(row)
                size, previous = size + len(row[3]), row[0]
        if held:
            yield mark()

    return spread.mapInArrow(index, RUNS)


def _counted(strings: DataFrame) -> DataFrame:
    """RUNS of the repeated starts among strings (anchor, segment, off, h1, h2, n), by their hashes."""
    same = cut(strings.groupBy("anchor", "h1", "h2").agg(F.sum("n").alias("_n")).filter(F.col("_n") > 1).drop("_n"))
    hits = strings.join(same, ["anchor", "h1", "h2"], "left_semi")
    return hits.select("anchor", "segment", F.col("off").alias("low"), F.col("off").alias("high"))


def find_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(key, spans): merged byte ranges [start, end) of each distinct text that strings occurring elsewhere cover."""
    anchors = cut(find_anchors(docs, length))
    # tables of their own wherever a key may be hot, so that Spark can split it in the join
    seen = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), (F.min("segment") != F.max("segment")).alias("mixed")).filter(F.col("_n") > 1).drop("_n")
    again = cut(anchors.join(cut(seen), "anchor"))
    alike = again.filter(~F.col("mixed")).select("key", F.col("first").alias("low"), F.col("last").alias("high"))

    kinds = (again.filter("mixed").groupBy("anchor", "segment")
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("_at"))
             .select("anchor", "segment", F.least("n", F.lit(2)).cast("int").alias("n"), "_at.key", "_at.first", "_at.last"))
    kinds = cut(kinds)
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_k")).select("anchor", (F.col("_k") > GROUP).alias("hot"))
    wanted = cut(kinds.join(cut(many), "anchor"))
    texts = docs.select(F.unhex(F.md5(whole_text())).alias("key"), whole_text().alias("text"))
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))

    # counts of 1 and 2 are all that matters; 4 marks hot anchors
    flagged = wanted.withColumn("n", (F.col("n") + F.when(F.col("hot"), 4).otherwise(0)).cast("int"))
    segments = cut(_extracted(texts, flagged, length, "anchor bigint, segment bigint, n int, data binary",
                              lambda w, data: [(w["anchor"], w["segment"], w["n"], data)]))
    calm = segments.filter(F.col("n") < 4)
    runs = _indexed(calm, length)
    strings = cut(_strings(segments.filter(F.col("n") >= 4), length))
    runs = cut(runs.unionByName(_counted(strings)))
    mixed = (again.filter("mixed").join(runs, ["anchor", "segment"])
             .select("key", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")))
    marks = alike.unionByName(mixed).distinct()
    return marks.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("starts"))


def _strings(segments: DataFrame, length: int) -> DataFrame:
    """Every owned string of the segments of hot anchors, as two hashes; ``off`` counts from the segment's first start."""
    schema = "anchor bigint, segment bigint, off int, h1 bigint, h2 bigint, n int"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, n, raw in zip(*[batch.column(c).to_pylist() for c in ("anchor", "segment", "n", "data")]):
                data = np.frombuffer(raw, np.uint8)
                off = np.arange(len(data) - length + 1)
                both = [_between(_prefix_hashes(data, codes), off, off + length).view(np.int64) for codes in (_BYTE, _BYTE2)]
                size = len(off)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, anchor)), pa.array(np.full(size, segment)), pa.array(off.astype(np.int32)), pa.array(both[0]), pa.array(both[1]),
                     pa.array(np.full(size, n - 4, np.int32))], ["anchor", "segment", "off", "h1", "h2", "n"])

    return segments.mapInArrow(emit, schema)


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary]), one row per input row.

    Every byte that a string of ``length`` bytes covers which also starts
    anywhere else, in the same text or another, is removed; strings never cross
    texts and are judged on the input. Null texts are empty; empty and shorter
    texts lose nothing. Repeated rows are copies of each other and lose all
    from ``length`` bytes on. Ids may be null or repeated; extra columns are
    ignored; an empty table gives an empty table. Texts are cut at bytes, so
    ``kept`` need not be valid UTF-8.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    keyed = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"))
    marks = find_repeats(rows, length)
    texts = rows.groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.first("text").alias("text"))
    schema = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found: list[list] = [[] for _ in schema.split(", ")]
                for key, text, starts in zip(*[part.column(c).to_pylist() for c in ("key", "text", "starts")]):
                    raw = text.encode()
                    spans = merged([(s["low"], s["high"] + length) for s in starts or ()])
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    left = b"".join(kept)
                    for column, value in zip(found, (key, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)):
                        column.append(value)
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], [p.split()[0] for p in schema.split(", ")])

    done = texts.join(marks, "key", "left").select("key", "text", "starts").mapInArrow(apply, schema)
    return keyed.join(done, "key", "left").drop("key")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch are one."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], b))
        else:
            found.append((a, b))
    return found
