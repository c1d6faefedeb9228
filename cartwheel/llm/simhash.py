"""SimHash fingerprints and their near copies by ball hashing from both ends.

Two fingerprints at most three bits apart meet half-way: a block of bits that
holds at least one of the differences is masked, and of the two or fewer that
remain each side changes at most one. So every distinct fingerprint emits, for
each of ``BLOCKS`` masked blocks, itself and all variants one bit away (196 rows
instead of the 2,081 of a ball of radius two over all bits). Rows are shuffled
on the variant; fingerprints that collide are verified bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.common import chunks
from cartwheel.llm.components import components

BITS, RADIUS, BLOCKS, SHINGLE, SEED = 64, 3, 4, 3, 42
# groups of up to SMALL fingerprints are compared by shifts, up to DENSE by a matrix, larger ones by looking neighbours up
SMALL, DENSE = 16, 1024
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ONE = np.uint64(1)


def fingerprint(text: str) -> int:
    """Bits set in more than half of the shingles' XXH64; 0 without words."""
    import xxhash

    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())       # of bytes: A-Z alone change
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8", len(shingles))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return int((_ONE << bits.astype(np.uint64)).sum(dtype=np.uint64)) if len(bits) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint): the signed form of each whole text's fingerprint, null texts as empty."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(compute, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp bigint")


def variants(distinct: DataFrame) -> DataFrame:
    """(block, variant, fp): the radius-one ball of each fingerprint with each block masked."""
    width = BITS // BLOCKS
    masks = [np.uint64(2**64 - 1) ^ (np.uint64((1 << width) - 1) << np.uint64(width * b)) for b in range(BLOCKS)]
    flips = [np.array([0, *(1 << i for i in range(BITS) if int(m) >> i & 1)], np.uint64) for m in masks]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for start in range(0, len(values), 2048):
                part = values[start:start + 2048]
                for block in range(BLOCKS):
                    ball = ((part & masks[block])[:, None] ^ flips[block][None, :]).reshape(-1)
                    own = np.repeat(part, len(flips[block]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ball), block, np.int8)), pa.array(ball.view(np.int64)), pa.array(own.view(np.int64))],
                        ["block", "variant", "fp"])

    return distinct.select("fp").mapInArrow(emit, "block tinyint, variant bigint, fp bigint")


def _small_groups(values: np.ndarray, group: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Near pairs within groups of at most SMALL members; rows of a group follow each other."""
    found = []
    for lag in range(1, SMALL):
        same = np.flatnonzero((group[lag:] == group[:-lag]) & (size[lag:] <= SMALL) & (size[lag:] > lag))
        near = np.bitwise_count(values[same] ^ values[same + lag]) <= RADIUS
        found.append((values[same[near]], values[same[near] + lag]))
    return found


def _dense_group(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each set of connected members."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return values, values[label]
        label = new


def _large_group(values: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs by looking up, in time linear in the members.

    Members differ from the variant in the masked block and in at most one bit
    outside, so they fall into few classes by the bits outside, each a set of
    block values; a neighbour's block value is the own one with up to three
    bits flipped.
    """
    width = BITS // BLOCKS
    shift, inside = np.uint64(width * block), np.uint64((1 << width) - 1)
    low, outside = (values >> shift) & inside, values & ~(inside << shift)
    flips = [np.uint64(x) for x in range(1 << width) if x.bit_count() <= RADIUS]
    classes = {o: low[outside == o] for o in np.unique(outside)}
    there = {o: np.bincount(rows.astype(np.int64), minlength=1 << width).astype(bool) for o, rows in classes.items()}
    for one, rows in classes.items():
        for other, present in there.items():
            apart = (int(one) ^ int(other)).bit_count()
            if other < one or apart > RADIUS:
                continue
            for flip in flips:
                if int(flip).bit_count() + apart <= RADIUS and (flip or one != other):
                    hit = rows[present[(rows ^ flip).astype(np.int64)]]
                    if len(hit):
                        yield one | (hit << shift), other | ((hit ^ flip) << shift)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most three bits apart; every such pair is connected by them."""
    rows = variants(distinct)
    sorted_rows = rows.repartition("block", "variant").sortWithinPartitions("block", "variant")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate(side) for side in zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(side.copy().view(np.int64)) for side in (pairs[:, 0], pairs[:, 1])], ["a", "b"])

        def check(block: np.ndarray, variant: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.append(True, (variant[1:] != variant[:-1]) | (block[1:] != block[:-1]))
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(values)))
            group = np.cumsum(first) - 1
            found = _small_groups(values, group, size[group])
            for at, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                if n <= DENSE:
                    found.append(_dense_group(values[at:at + n]))
                else:
                    for some in _large_group(values[at:at + n], int(block[at])):
                        yield batch_of([some])
            yield batch_of(found)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("block", "variant", "fp")]
            block, variant, values = (np.concatenate([h, n]) for h, n in zip(held, (new[0], new[1], new[2].view(np.uint64))))
            if not len(values):
                continue
            last = np.flatnonzero((variant != variant[-1]) | (block != block[-1]))
            edge = int(last[-1]) + 1 if len(last) else 0          # the last group may go on in the next batch
            held = (block[edge:], variant[edge:], values[edge:])
            if edge:
                yield from check(block[:edge], variant[:edge], values[:edge])
        if len(held[2]):
            yield from check(*held)

    return sorted_rows.mapInArrow(verify, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; extra columns are ignored.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest id that is
    reachable through links of three bits or fewer, the row's own included.
    Texts without words have fingerprint 0 and link like any other. Null texts
    are empty; null ids take part but are never the smallest (a component of
    null ids only has a null component). Copies are reduced to distinct
    fingerprints before any variant is made. Empty table: empty result.
    """
    marked = cut(fingerprints(docs))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    reached = components(links(classes))
    labelled = cut(classes.join(reached, classes["fp"] == reached["node"], "left")
                   .select("fp", "_least", F.coalesce("label", "fp").alias("_label")))
    roots = cut(labelled.groupBy("_label").agg(F.min("_least").alias("component_id")))
    by_fp = labelled.join(roots, "_label").select("fp", "component_id")
    return (marked.join(by_fp, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
