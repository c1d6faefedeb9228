"""Alignment of two tokenizers by the byte offsets at which both end a token.

The ends of a text's tokens are two rising lists. Each end of the shorter list
gallops into the longer one: probes at doubling distances from where an earlier
end was found, then a binary search between the last two. Ends found in both
lists cut the text into groups, and the ranks found are the first and the last
token that each token of the shorter list overlaps. Many lists are searched at
once in numpy.

Both tokenizers always end a token where a blank or line feed follows a visible
character. These common ends are known beforehand, so a text is searched
stretch by stretch between them, and a stretch that comes again in a task is
not searched again. A text without such places is one stretch.

How often two ids are linked is a count over all texts. A block of texts sends
each of its distinct pairs once; the counts come back to the block that holds
the links.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.common import chunks, spread
from cartwheel.llm.wordmemo import pieces

BLOCK_CHARS, PORTION_CHARS = 2_000_000, 500_000
# fixed values: characters after which a blank may belong to the same piece (white space of any of the libraries)
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
# fixed value: how byte-level tokenizers part a text before any merge
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a stretch: blanks and line feeds, then visible characters; other white space draws the blanks behind it in
_STRETCH = re.compile(f"[ \n]*(?:[^ \n]+(?:(?<=[{_SPACES}])[ \n]+)?)+|[ \n]+")
# what may be coded many at once with line feeds between
_JOINS = re.compile(f" ?[^{_SPACES}]+")


def keys_of(text: str) -> list[str]:
    """Keys of the stretches of a blank and the text; see ``stretch`` for what a key stands for.

    Plain texts have shorter ones: stops and line feeds by themselves.
    """
    found = pieces(text)
    if not found or text[0] in " \n" or text[-1] in " \n":
        return _STRETCH.findall(" " + text)
    if found[0][:1] == "\t":
        found[0] = found[0][1:]            # the blank before the text
    return [k for k in found if k != "\t"] if "\t" in found else found


def stretch(key: str) -> str:
    """A tab says that no blank precedes a word; stretches of other texts are their own keys."""
    return key[1:] if key[:1] == "\t" else key if key[:1] in " \n" else " " + key


# ---- the two tokenizers ---------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level file of the tokenizers library, special tokens' strings as plain text.

    Where the file's merges are in the order of their ids, its tokens are
    ranks, and tiktoken merges by them, several times as fast.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.library.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        described = json.loads(self.library.to_str())
        split = described["pre_tokenizer"] or {}
        # only then does white space part the pieces
        self.by_stretch = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not described["normalizer"]
        self.ranked = self._by_rank(described, letters) if self.by_stretch else None

    def _by_rank(self, described: dict, letters: dict[str, int]):
        model, special = described["model"], {t["content"] for t in described["added_tokens"]}
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        if any((model.get(k) or v) != v for k, v in plain.items()):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        if made != sorted(set(made)) or len(made) + 256 != len(ranks) or max(ranks[bytes([b])] for b in range(256)) > made[0]:
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def codes(self, texts: Sequence[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]


class Pieces:
    """Ids by sentencepiece, which puts a blank before every text; ``codes`` takes stretches, which begin with that blank or have none."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        as_byte = [self.library.is_byte(i) for i in range(len(pieces))]
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, as_byte)]
        self.blank = self.library.piece_to_id("▁")
        keeps_blanks = b"".join(self.bytes[i] for i in self.library.encode("x  y \n z ")) == b" x  y \n z "
        self.by_stretch = keeps_blanks and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def codes(self, texts: Sequence[str]) -> list[list[int]]:
        begins = [t[:1] == " " for t in texts]
        # no piece holds a line feed, so what follows one is coded as after any other end
        found = self.library.encode([t[1:] if b else "\n" + t for t, b in zip(texts, begins)], num_threads=1)
        return [ids if b and len(t) > 1 else [self.blank] if b else ids[2:] for t, b, ids in zip(texts, begins, found)]


class Ragged:
    """A growing list of integer lists in one array."""

    def __init__(self):
        self.values, self.cuts, self.rows = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used, rows = self.cuts[self.rows], self.rows + len(sizes)
        while used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while rows + 1 > len(self.cuts):
            self.cuts = np.concatenate([self.cuts, np.zeros_like(self.cuts)])
        self.values[used:used + len(values)] = values
        self.cuts[self.rows + 1:rows + 1] = used + np.cumsum(sizes)
        self.rows = rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values one after another, and the number of each row's."""
        first, sizes = self.cuts[rows], self.cuts[rows + 1] - self.cuts[rows]
        return self.values[spread(first, sizes)], sizes


# ---- galloping ------------------------------------------------------------------------

def gallop(short: np.ndarray, short_cuts: np.ndarray, long: np.ndarray, long_cuts: np.ndarray) -> np.ndarray:
    """For every end in the shorter lists the place of the first end of the longer one that is not before it.

    Lists of several texts stand one after another, parted by the cuts; each
    rises, and the last ends of a text's two lists are equal. Ends whose number
    has the most trailing zero bits go first, and each one starts where the
    end before it among those was found.
    """
    counts = np.diff(short_cuts)
    number = np.arange(len(short)) - np.repeat(short_cuts[:-1], counts)
    begin, stop = np.repeat(long_cuts[:-1], counts), np.repeat(long_cuts[1:], counts)
    place = np.zeros(len(short), np.int64)
    lowest = number & -number
    steps = [0] + [1 << b for b in reversed(range(int(counts.max(initial=0)).bit_length()))]
    for step in steps:
        rows = np.flatnonzero(lowest == step)
        if not len(rows):
            continue
        wanted = short[rows]
        low = begin[rows] if step == 0 else place[rows - step]
        high = low.copy()
        open_, reach = np.arange(len(rows)), 0
        while len(open_):                                   # exponential: low stays behind the last end that was too small
            probe = np.minimum(low[open_] + reach, stop[rows[open_]] - 1)
            small = long[probe] < wanted[open_]
            high[open_] = probe
            open_, probe = open_[small], probe[small]
            low[open_] = probe + 1
            reach = max(1, reach * 2)
        open_ = np.flatnonzero(low < high)
        while len(open_):                                   # binary: the answer is in [low, high]
            middle = (low[open_] + high[open_]) >> 1
            small = long[middle] < wanted[open_]
            low[open_] = np.where(small, middle + 1, low[open_])
            high[open_] = np.where(small, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place[rows] = low
    return place


def overlaps(short: np.ndarray, short_cuts: np.ndarray, long: np.ndarray, long_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, shared): the tokens of the longer lists that each token of the shorter ones overlaps, and whether their ends meet."""
    last = gallop(short, short_cuts, long, long_cuts)
    shared = long[last] == short if len(short) else np.zeros(0, bool)
    first = np.empty_like(last)
    first[1:] = (last + shared)[:-1]
    begins = short_cuts[:-1][np.diff(short_cuts) > 0]
    first[begins] = long_cuts[:-1][np.diff(short_cuts) > 0]
    return first, last, shared


class Aligned:
    """Groups and links of stretches, put in the order ``order``: those whose A list drives the search, then the others."""

    def __init__(self, ids: Sequence[np.ndarray], numbers: Sequence[np.ndarray], lengths: Sequence[np.ndarray]):
        drives = numbers[0] <= numbers[1]
        self.order = np.concatenate([np.flatnonzero(drives), np.flatnonzero(~drives)])
        split = int(drives.sum())
        self.numbers = [n[self.order] for n in numbers]
        starts = [np.cumsum(n) - n for n in numbers]
        self.ids = [x[spread(s[self.order], n)] for x, s, n in zip(ids, starts, self.numbers)]
        self.cuts = [np.append(0, np.cumsum(n)) for n in self.numbers]
        # ends count on from text to text; both sides of a text have the same bytes
        ends = [np.cumsum(size[x]) for size, x in zip(lengths, self.ids)]
        self.last = [np.zeros(len(x), bool) for x in self.ids]
        links: list[list[np.ndarray]] = [[], []]
        counted = []
        for drive, texts in ((0, slice(0, split)), (1, slice(split, len(self.order)))):
            bounds = [c[texts.start:texts.stop + 1] for c in self.cuts]
            mine, other = (slice(b[0], b[-1]) for b in (bounds[drive], bounds[1 - drive]))
            near, far = bounds[drive] - bounds[drive][0], bounds[1 - drive] - bounds[1 - drive][0]
            first, last, shared = overlaps(ends[drive][mine], near, ends[1 - drive][other], far)
            self.last[drive][mine] = shared
            self.last[1 - drive][other][last[shared]] = True
            sizes = last - first + 1
            links[drive].append(np.repeat(np.arange(len(sizes)), sizes) + mine.start)
            links[1 - drive].append(spread(first, sizes) + other.start)
            total = np.append(0, np.cumsum(sizes))
            counted.append(total[near[1:]] - total[near[:-1]])
        self.link_a, self.link_b = (np.concatenate(x) for x in links)
        self.n_links = np.concatenate(counted)
        shared_before = np.append(0, np.cumsum(self.last[0]))
        self.n_groups = shared_before[self.cuts[0][1:]] - shared_before[self.cuts[0][:-1]]

    def pairs(self) -> np.ndarray:
        """A id and B id of every link, stretch by stretch, in one number."""
        return (self.ids[0][self.link_a] << 32) | self.ids[1][self.link_b]

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every stretch."""
        ends = [np.append(0, np.flatnonzero(x) + 1) for x in self.last]
        group = [np.cumsum(x) - x for x in self.last]
        total = len(self.ids[0]) + len(self.ids[1])
        ids, mark = np.empty(total, np.int64), np.empty(total, np.uint8)
        for side, end, other_cut in ((0, b"|", group[0]), (1, b";", group[1] + 1)):
            at = np.arange(len(self.ids[side])) + ends[1 - side][other_cut]
            ids[at] = self.ids[side]
            mark[at] = np.where(self.last[side], end[0], ord(","))
        digits, sizes = _decimals(int(ids.max(initial=0)))
        bounds = np.append(0, np.cumsum(sizes[ids] + 1))[self.cuts[0] + self.cuts[1]].tolist()
        data = bytearray()
        for at in range(0, total, 500_000):
            some = ids[at:at + 500_000]
            text = digits[some]
            text[np.arange(len(some)), sizes[some]] = mark[at:at + 500_000]
            data += text[np.arange(text.shape[1]) <= sizes[some][:, None]].tobytes()
        data = bytes(data)
        return [data[a:b - 1] for a, b in zip(bounds, bounds[1:])]


_digits: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``most``, left-aligned with room for one more byte, and their number."""
    width = len(str(most))
    if width not in _digits:
        text = np.arange(10 ** width).astype(f"S{width + 1}")
        _digits[width] = (text.view(np.uint8).reshape(-1, width + 1), np.char.str_len(text).astype(np.int64))
    return _digits[width]


class Both:
    """Both tokenizers and the alignment of stretches, with a memory of at most ``limit`` of them and one call's more.

    ``numbers`` has a row of (tokens of A, of B, groups, links) by stretch, ``texts`` its groups as text, ``pairs`` its links.
    """

    def __init__(self, path_a: str, path_b: str, limit: int = 200_000):
        self.sides, self.limit = (ByteLevel(path_a), Pieces(path_b)), limit
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.sides]
        self.by_stretch = all(side.by_stretch for side in self.sides)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.numbers, self.exact, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, bool), Ragged()
        pa.default_memory_pool().release_unused()

    def rows(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all texts' stretches one after another, their number by text), valid until the next call.

        A text has none if it is empty, or if its bytes do not come back from
        either side's tokens. Keys are made for about PORTION_CHARS at a time.
        """
        if len(self.known) > self.limit:
            self.forget()
        found, start, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 0
        for at, text in enumerate(texts, 1):
            size += len(text)
            if size >= PORTION_CHARS or at == len(texts):
                found.append(self._portion(texts[start:at]))
                start, size = at, 0
        flat, sizes = zip(*found)
        return np.concatenate(flat), np.concatenate(sizes)

    def _portion(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        keys = [(keys_of(t) if self.by_stretch else [" " + t]) if t else [] for t in texts]
        found = self._look_up(keys)
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        owner = np.repeat(np.arange(len(texts)), sizes)
        fails = np.unique(owner[~self.exact[flat]])
        if len(fails):              # the whole text decides, as one stretch
            exact = [self._exact(" " + texts[i]) for i in fails.tolist()]
            if any(exact):
                keys = [[" " + t] if i in set(fails[exact].tolist()) else k for i, (t, k) in enumerate(zip(texts, keys))]
                found = self._look_up(keys)
            for i in fails[~np.array(exact)].tolist():
                found[i] = []
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
        return flat, sizes

    def _exact(self, text: str) -> bool:
        return all(b"".join(side.bytes[x] for x in side.codes([text])[0]) == text.encode() for side in self.sides)

    def _look_up(self, keys: list[list[str]]) -> list[list[int]]:
        found = [list(map(self.known.get, some)) for some in keys]
        open_ = [i for i, some in enumerate(found) if None in some]
        if open_:
            new = list(dict.fromkeys(k for i in open_ for k, row in zip(keys[i], found[i]) if row is None))
            self._learn(new)
            for i in open_:
                found[i] = list(map(self.known.__getitem__, keys[i]))
        return found

    def _learn(self, keys: list[str]) -> None:
        parts = list(map(stretch, keys))
        joins = [self.by_stretch and _JOINS.fullmatch(p) is not None for p in parts]
        order = [i for i, j in enumerate(joins) if j]
        many = len(order)
        order += [i for i, j in enumerate(joins) if not j]
        keys, parts = [keys[i] for i in order], [parts[i] for i in order]
        raw = [p.encode() for p in parts]
        exact, ids, numbers = np.ones(len(parts), bool), [], []
        for side, lengths in zip(self.sides, self.lengths):
            values, sizes = [], []
            steps = [(at, min(at + 4000, many), True) for at in range(0, many, 4000)]
            steps += [(at, at + 4000, False) for at in range(many, len(parts), 4000)]
            for a, b, joined in steps:
                got = self._joined(side, lengths, parts[a:b], raw[a:b]) if joined else None
                if got is None:
                    lists = side.codes(parts[a:b])
                    exact[a:b] &= np.fromiter((b"".join([side.bytes[x] for x in one]) == r for one, r in zip(lists, raw[a:b])), bool, len(lists))
                    got = (np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))
                values.append(got[0])
                sizes.append(got[1])
            ids.append(np.concatenate(values))
            numbers.append(np.concatenate(sizes))
        keep = [np.repeat(exact, n) for n in numbers]
        aligned = Aligned([x[k] for x, k in zip(ids, keep)], [np.where(exact, n, 0) for n in numbers], self.lengths)
        known = len(self.known)
        self.known.update(zip([keys[i] for i in aligned.order.tolist()], range(known, known + len(keys))))
        self.texts += aligned.group_texts()
        self.numbers = np.concatenate([self.numbers, np.stack([*aligned.numbers, aligned.n_groups, aligned.n_links], axis=1)])
        self.exact = np.concatenate([self.exact, exact[aligned.order]])
        self.pairs.extend(aligned.pairs(), aligned.n_links)

    @staticmethod
    def _joined(side, lengths: np.ndarray, parts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, their number by part) of parts coded in one text, a line feed before each; None if its bytes do not come back."""
        ids = side.codes([" x\n" + "\n".join(parts)])[0]
        if b"".join([side.bytes[x] for x in ids]) != b" x\n" + b"\n".join(raw):
            return None
        ids = np.array(ids, np.int64)
        ends = np.cumsum(lengths[ids])
        stop = 2 + np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        start = np.append(2, stop[:-1]) + 1
        first, last = np.searchsorted(ends, start), np.searchsorted(ends, stop)
        if (ends[first] != start).any() or (ends[last] != stop).any():
            return None
        sizes = last - first
        return ids[spread(first + 1, sizes)], sizes


_both: dict[tuple[str, str], Both] = {}


def both_tokenizers(path_a: str, path_b: str) -> Both:
    """The worker's tokenizers and memory, kept between tasks."""
    if (path_a, path_b) not in _both:
        _both.clear()
        _both[path_a, path_b] = Both(path_a, path_b)
    return _both[path_a, path_b]


# ---- over a corpus --------------------------------------------------------------------

BLOCKS = ("block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "groups_sha256 array<string>, n_stretches array<bigint>, pairs binary, counts binary, stretches binary, links binary, sizes binary")
PAIRS = "block bigint, at int, pair bigint, n bigint"
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, compressed; small numbers leave whole planes zero."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def align_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """BLOCKS: texts of about BLOCK_CHARS with the numbers of their stretches, the pairs of each stretch, and the block's pairs with counts."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_tokenizers(path_a, path_b)
        for block, (doc_ids, texts) in enumerate(_blocks(batches), TaskContext.get().partitionId() << 33):
            yield _block_row(both, block, doc_ids, texts)
        both.forget()           # the worker waits for tasks of other kinds

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(emit, BLOCKS)


def _block_row(both: Both, block: int, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """One row of BLOCKS."""
    rows, sizes = both.rows(texts)
    stops = np.cumsum(sizes)
    numbers = [_sums(column[rows], sizes) for column in both.numbers.T]
    at = zip((stops - sizes).tolist(), stops.tolist())
    digests = [hashlib.sha256(b";".join(map(both.texts.__getitem__, rows[a:b].tolist()))).hexdigest() if b > a else "" for a, b in at]
    kinds, of_kind, times = _by_count(rows)
    links, n_links = both.pairs.take(kinds)
    pairs, of_pair, counts = _by_count(links, np.repeat(times, n_links))
    columns = [[block], [doc_ids], *[[x.tolist()] for x in numbers], [digests], [sizes.tolist()],
               [pairs.astype("<i8").tobytes()], [counts.astype("<i8").tobytes()], [_packed(of_kind)], [_packed(of_pair)], [_packed(n_links)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(BLOCKS))], schema=_arrow(BLOCKS))


def _by_count(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values by falling count, each value's place among them, counts); frequent ones have small places."""
    distinct, place = np.unique(values, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, place, 1 if times is None else times)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return distinct[order], number[place], counts[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about BLOCK_CHARS, also across Spark's batches; a batch's texts are read 256 rows at a time."""
    slices = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
    doc_ids, texts, size = [], [], 0
    for batch, some in chunks(slices, "text", BLOCK_CHARS):
        more = sum(map(len, some))
        if texts and size + more > BLOCK_CHARS:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
        doc_ids, texts, size = doc_ids + batch.column("doc_id").to_pylist(), texts + some, size + more
    if texts:
        yield doc_ids, texts


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
            pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block, np.int64)), pa.array(np.arange(len(pair), dtype=np.int32)),
                                              pa.array(pair), pa.array(n)], schema=_arrow(PAIRS))


def _finish(key, block: pa.Table, judged: pa.Table) -> pa.Table:
    """One block's texts with the corpus-wide counts of their links."""
    row = block.slice(0, 1).to_pylist()[0]
    at = judged.column("at").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = judged.column("count").to_numpy(), judged.column("best").to_numpy(zero_copy_only=False)
    links, sizes, stretches = (_unpacked(row[c]).astype(np.int64) for c in ("links", "sizes", "stretches"))
    found = []
    for value in (best, count):
        by_stretch = _sums(value[links], sizes)
        found.append(_sums(by_stretch[stretches], np.array(row["n_stretches"], np.int64)))
    n_best, count_sum = found
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum, row["groups_sha256"]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(ALIGNED))], schema=_arrow(ALIGNED))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive ``sizes`` values."""
    total, ends = np.append(0, np.cumsum(values)), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ALIGNED: one row per input row; see ``Aligned`` for groups and links.

    ``path_a`` is a byte-level file of the tokenizers library, which codes a
    blank and the text; ``path_b`` a sentencepiece model, which puts that blank
    itself. ``n_best`` are the links whose pair is the most frequent one of
    their B id over all texts, ties included; ``count_sum`` adds up the
    corpus-wide counts of a text's links.

    Null and empty texts, and texts whose bytes do not come back from either
    side's tokens, have no tokens: zeros and an empty digest. Ids may be null
    or repeated, every row is counted and has its row; extra columns are
    ignored; an empty table gives an empty table. A text is aligned whole, so a
    task's memory follows the longest text, and links are split by blocks of
    texts, not by id.
    """
    blocks = cut(align_blocks(docs, path_a, path_b))
    found = blocks.select("block", "pairs", "counts").mapInArrow(_block_pairs, PAIRS)
    totals = cut(found.groupBy("pair").agg(F.sum("n").alias("count")))
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b")
    most = cut(totals.groupBy(id_b).agg(F.max("count").alias("_most")))            # at most a row per B id
    judged = totals.withColumn("id_b", id_b).join(most, "id_b").select("pair", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))
    back = found.select("block", "at", "pair").join(judged, "pair").select("block", "at", "count", "best")
    rows = blocks.drop("pairs", "counts")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finish, ALIGNED)
