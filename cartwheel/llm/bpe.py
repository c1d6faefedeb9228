"""Byte-level BPE in numpy, and back.

Distinct pre-tokens are put into padded matrices by length. In every round
each row merges its leftmost pair of minimum rank; pairs are looked up in a
hash table, and rows without a mergeable pair leave the matrix. Pieces longer
than ``WIDEST`` bytes would need that many rounds over that many columns; they
merge by the same rule with a heap over a linked list.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartwheel.llm.common import chunks
from cartwheel.llm.wordmemo import CodeMemo, Memo, raw, spaced

WIDEST = 256
NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, by open addressing in numpy arrays."""

    def __init__(self, pairs: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        self.longest = 0
        at, left = self._home(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            tried = left[free]
            _, first = np.unique(at[tried], return_index=True)      # one pair takes a free slot
            placed = tried[first]
            self.keys[at[placed]], self.values[at[placed]] = pairs[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.longest += 1

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _SPREAD) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none."""
        wanted = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(wanted)
        keys = self.keys[at]
        found = np.where(keys == wanted, self.values[at], NONE)
        open_ = np.flatnonzero((keys != wanted) & (keys != np.uint64(2**64 - 1)))
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            keys = self.keys[at[open_]]
            hit = keys == wanted[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (keys != np.uint64(2**64 - 1))]
        return found


class BytePairs:
    """Encoder and decoder for a file of byte ranks and a pattern that splits text before merges."""

    def __init__(self, path: str, pattern: str, limit: int = 350_000):
        import regex

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(splits, np.uint64).reshape(-1, 3)
        self.pairs = PairTable((table[:, 0] << np.uint64(32)) | table[:, 1], table[:, 2].astype(np.int32))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pretokens = Memo(self._merge_all, limit)
        self.memo = CodeMemo(self._pieces, limit)

    def forget(self) -> None:
        """Drop what was remembered: workers wait for the next task, perhaps of another kind, with little memory."""
        self.pretokens.known = {}
        self.memo.forget()

    # ---- encoding ----------------------------------------------------------------------

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, as the merge ranks give them; no special tokens."""
        split = [spaced(t) if t else None for t in texts]
        whole = [self.pattern.findall(t) for t, s in zip(texts, split) if s is None]
        plain = iter(self.memo.encode([s for s in split if s is not None]))
        odd = iter(self.pretokens.look_up(whole))
        return [np.frombuffer(b"".join(next(odd)) if s is None else next(plain), "<u4") for s in split]

    def _pieces(self, keys: list[str]) -> list[bytes]:
        # a word of letters is one pre-token with its blank, and is remembered by its key alone
        words = [k for k in keys if k.isalpha()]
        found = dict(zip(words, self._merge_all([" " + k for k in words])))
        other = [k for k in keys if not k.isalpha()]
        found.update(zip(other, (b"".join(v) for v in self.pretokens.look_up([self.pattern.findall(raw(k)) for k in other]))))
        return [found[k] for k in keys]

    def _merge_all(self, pretokens: list[str]) -> list[bytes]:
        data = [t.encode() for t in pretokens]
        found: list[bytes] = [b""] * len(data)
        # lengths in steps of an eighth of a power of two, so that padding stays small
        by_length = sorted(range(len(data)), key=lambda i: len(data[i]))
        bucket = lambda i: -1 if len(data[i]) > WIDEST else max(2, len(data[i]) + len(data[i]) % 2 if len(data[i]) <= 16 else -(-len(data[i]) // 16) * 16)
        for width, group in itertools.groupby(by_length, key=bucket):
            rows = list(group)
            if width == -1:
                for i in rows:
                    found[i] = self._merge_long(data[i])
                continue
            most = max(1, 1_000_000 // width)
            for start in range(0, len(rows), most):
                part = rows[start:start + most]
                for i, ids in zip(part, self._merge_matrix([data[i] for i in part], width)):
                    found[i] = ids
        return found

    def _merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        lengths = np.array([len(w) for w in words])
        padded = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.single[padded]
        inside = np.arange(width - 1)[None, :] < (lengths - 1)[:, None]
        ranks = np.full((n, width - 1), NONE, np.int32)
        ranks[inside] = self.pairs.ranks(ids[:, :-1][inside], ids[:, 1:][inside])
        done: list[bytes] = [b""] * n
        alive = np.arange(n)
        while len(alive):
            at = ranks.argmin(axis=1)                           # the leftmost minimum
            row = np.arange(len(alive))
            best = ranks[row, at]
            over = best == NONE
            if over.any():                                      # compaction
                for i, ids_row, length in zip(alive[over].tolist(), ids[over], lengths[over].tolist()):
                    done[i] = ids_row[:length].astype("<u4").tobytes()
                keep = ~over
                alive, ids, ranks, lengths, at, best = alive[keep], ids[keep], ranks[keep], lengths[keep], at[keep], best[keep]
                row = np.arange(len(alive))
                if not len(alive):
                    break
                used = int(lengths.max())
                ids, ranks = ids[:, :used], ranks[:, :used - 1]
            columns = np.arange(ids.shape[1] - 1)[None, :]
            shifted = columns + (columns > at[:, None])         # drops the right half of the pair
            ids[row, at] = best
            ids = np.take_along_axis(ids, shifted, axis=1)
            ranks = np.where(columns[:, :-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1]) if ids.shape[1] > 1 else ranks[:, :0]
            lengths = lengths - 1
            for side in (-1, 0):                                # the pairs that hold the merged id
                first = at + side
                ok = (first >= 0) & (first < lengths - 1)
                r, f = row[ok], first[ok]
                ranks[r, f] = self.pairs.ranks(ids[r, f], ids[r, f + 1])
                if side == 0:
                    ended = row[first == lengths - 1]
                    inside_ = at[ended] < ranks.shape[1]
                    ranks[ended[inside_], at[ended[inside_]]] = NONE
            if ids.shape[1] == 1:
                ranks = np.full((len(alive), 1), NONE, np.int32)
        return done

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.single[np.frombuffer(word, np.uint8)]
        n = len(ids)
        heap = [(r, i) for i, r in enumerate(self.pairs.ranks(ids[:-1], ids[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in rank_of:
                rank_of[a, b] = int(self.pairs.ranks(np.array([a]), np.array([b]))[0])
            return rank_of[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                continue                                        # an older pair at this place
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (new := rank(ids[a], ids[after[a]])) != NONE:
                    heapq.heappush(heap, (new, a))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # ---- decoding ----------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The worker's encoder, kept between tasks."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = BytePairs(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row in any order; null and empty texts have no ids.

    Extra columns are ignored, repeated rows and ids keep a row each, an empty
    table gives an empty table.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pairs(path, pattern)
        for batch, texts in chunks(batches, "text"):
            ids = encoder.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])
        encoder.forget()

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(encode, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for; null ids give null."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pairs(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                data = [None if not s.is_valid else encoder.decode(s.values.to_numpy(zero_copy_only=False)) for s in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(decode, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, data binary")


def _digests(ids: np.ndarray, ends: np.ndarray, tokens: Sequence[bytes]) -> tuple[list[str], list[str]]:
    """SHA-256 of every text's ids (little-endian, 32 bits) and of the bytes they decode to; the ids of all texts in one array."""
    raw, spelled = memoryview(ids.astype("<u4").tobytes()), list(map(tokens.__getitem__, ids.tolist()))
    cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    return ([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in cuts], [hashlib.sha256(b"".join(spelled[a:b])).hexdigest() for a, b in cuts])


DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def round_trip_digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids (little-endian, 32 bits) and of the bytes they decode to.

    The decoded bytes are digested where they arise, a few hundred documents at a time.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_pairs(path, pattern).tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("ids")
                ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                both = _digests(lists.flatten().to_numpy(zero_copy_only=False), ends, tokens)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), *[pa.array(d, pa.string()) for d in both]], DIGESTS)

    kept = encoded.select("doc_id", "ids")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): as ``encode_documents``, with the digests of ``round_trip_digests``, in one pass of the texts."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pairs(path, pattern)
        for batch, texts in chunks(batches, "text", 1_000_000):
            ids = encoder.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([*ids, np.zeros(0, "<u4")])
            both = _digests(flat, ends, encoder.tokens)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), *[pa.array(d, pa.string()) for d in both], lists],
                                             [*DIGESTS, "ids"])
        encoder.forget()

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>")
