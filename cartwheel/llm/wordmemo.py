"""Encoding texts piece by piece, each distinct piece once per worker.

The tokenizers here split a text before any merge, and never across the place
where a visible character is followed by a single blank or line feed. A plain
text (printable ASCII, Latin-1 letters, no doubled white space, no special
token) is therefore the concatenation of pieces whose codes depend on the piece
alone. Everything else is handed to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartwheel.llm.common import spread

# fixed values: the characters of a plain text; a stop after another punctuation mark, which belongs to that mark
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
MARK_AND_STOP = re.compile(r"[!-/:-@\[-`{-~][.,][ \n]")
DOUBLED = ("  ", " \n", "\n ", "\n\n", "<|")


def is_plain(text: str) -> bool:
    return not (any(d in text for d in DOUBLED) or not PLAIN.fullmatch(text) or MARK_AND_STOP.search(text))


def spaced(text: str) -> str | None:
    """Keys of the pieces of a plain text with a blank between each two, else None. See ``raw`` for what a key stands for.

    A stop between a visible character and white space is a piece of its own,
    so that a word is one key with and without it, and so is a line feed. A stop
    after a blank is one piece with that blank. An empty text has no keys.
    """
    if not is_plain(text):
        return None
    keys = text.replace(", ", " \t, ").replace(". ", " \t. ").replace(".\n", " \t.\n").replace(",\n", " \t,\n")
    keys = keys.replace("  \t", " ")        # a plain text has no doubled blanks: these stops have a blank before them
    keys = keys.replace("\n", " \n \t")
    return keys[1:] if keys[:1] == " " else keys if keys[:1] in ("", "\t") else "\t" + keys


def pieces(text: str) -> list[str] | None:
    """Keys of the pieces of a plain text, else None."""
    keys = spaced(text)
    return None if keys is None else keys.split(" ") if text else []


def bare_words(text: str) -> str | None:
    """Keys of a plain text for tokenizers that drop case and white space, with blanks between, else None; an empty key is none."""
    if not is_plain(text):
        return None
    return text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ").replace("\n", " ")


def raw(key: str) -> str:
    """The piece of text a key stands for: a tab says that no blank precedes it."""
    return key if key == "\n" else key[1:] if key[:1] == "\t" else " " + key


class Memo:
    """Key -> value for about ``limit`` keys at most; emptied when full. Values come from ``resolve``."""

    def __init__(self, resolve: Callable[[list[str]], Sequence], limit: int):
        self.resolve, self.limit, self.known = resolve, limit, {}

    def look_up(self, key_lists: Sequence[Sequence[str]]) -> list[list]:
        """The values of every list's keys."""
        values = [list(map(self.known.get, keys)) for keys in key_lists]
        open_lists = [at for at, found in enumerate(values) if None in found]
        new = {k for at in open_lists for k, v in zip(key_lists[at], values[at]) if v is None}
        if len(self.known) + len(new) > self.limit and self.known:
            self.known = {}
            new = {k for at in open_lists for k in key_lists[at]}
        keys = list(new)
        self.known.update(zip(keys, self.resolve(keys)))
        for at in open_lists:
            values[at] = list(map(self.known.__getitem__, key_lists[at]))
        return values


class CodeMemo:
    """Codes of texts given as keys with blanks between: key -> codes for about ``limit`` keys at most.

    A batch's keys are made distinct in Arrow, so a key is looked up once for a
    batch. A full memory keeps the keys that several batches have asked for, a
    half of its limit at most, and drops the others.
    """

    def __init__(self, resolve: Callable[[list[str]], Sequence[bytes]], limit: int):
        self.resolve, self.limit = resolve, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.codes, self.cuts, self.asked = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)
        pa.default_memory_pool().release_unused()

    def shrink(self) -> None:
        """Keep the keys asked for by most batches, at least two; all counts start again from one."""
        keys, codes, cuts, asked = list(self.known), self.codes, self.cuts, self.asked
        self.forget()
        rows = np.flatnonzero(asked > 1)
        if len(rows) > self.limit // 2:
            rows = np.sort(rows[np.argsort(-asked[rows], kind="stable")[:self.limit // 2]])
        sizes = cuts[rows + 1] - cuts[rows]
        self.known = {keys[row]: at for at, row in enumerate(rows.tolist())}
        self.codes, self.cuts = codes[spread(cuts[rows], sizes)], np.append(0, np.cumsum(sizes))
        self.asked = np.ones(len(rows), np.int32)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Every text's codes; none of the texts is empty."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        keys = lists.flatten().dictionary_encode()
        rows = self._rows(keys.dictionary.to_pylist())[keys.indices.to_numpy()]
        first, sizes = self.cuts[rows], self.cuts[rows + 1] - self.cuts[rows]
        data = self.codes[spread(first, sizes)].tobytes()
        ends = 4 * np.append(0, np.cumsum(sizes))[lists.offsets.to_numpy()]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _rows(self, keys: list[str]) -> np.ndarray:
        rows = list(map(self.known.get, keys))
        new = [k for k, row in zip(keys, rows) if row is None]
        if new and len(self.known) + len(new) > self.limit and self.known:
            self.shrink()
            rows = list(map(self.known.get, keys))
            new = [k for k, row in zip(keys, rows) if row is None]
        if new:
            found = self.resolve(new)
            self.codes = np.concatenate([self.codes, np.frombuffer(b"".join(found), "<u4")])
            start = len(self.known)
            self.cuts = np.append(self.cuts, self.cuts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4))
            self.known.update(zip(new, range(start, start + len(new))))
            self.asked = np.append(self.asked, np.zeros(len(new), np.int32))
            fresh = iter(range(start, start + len(new)))
            rows = [next(fresh) if row is None else row for row in rows]
        places = np.array(rows, np.int64)
        self.asked[places] += 1         # a batch's keys are distinct
        return places


class LibraryCodes:
    """Token ids by the tokenizers library, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts = self.ends.copy()
        for token, number in vocabulary.items():
            self.ends[number], self.starts[number] = token.endswith("</w>"), token.startswith("Ġ")
        self.marks_ends = bool(self.ends.any())       # such vocabularies are of lower-case words
        self.split = bare_words if self.marks_ends else spaced
        self.memo = CodeMemo(self._pieces, limit)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        split = [self.split(t) if t else None for t in texts]
        plain = iter(self.memo.encode([s for s in split if s is not None]))
        odd = iter([self._many([t])[0] if t else b"" for t, s in zip(texts, split) if s is None])
        return [next(odd) if s is None else next(plain) for s in split]

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, keys: list[str]) -> list[bytes]:
        words = [k for k in keys if k.isalpha()]
        other = [k for k in keys if not k.isalpha()]
        found = dict(zip(words, self._words(words)))
        found.update(zip(other, self._many([raw(k) if k or not self.marks_ends else "" for k in other])))
        return [found[k] for k in keys]

    def _words(self, words: list[str]) -> list[bytes]:
        """One call for many words; a word begins with a blank's mark or ends with the end mark."""
        found: list[bytes] = []
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.append(np.flatnonzero(self.starts[ids]), len(ids))
            if self.marks_ends:
                edges = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(edges) != len(part) + 1 or edges[0] != 0 or edges[-1] != len(ids):
                found += self._many([" " + w for w in part])
                continue
            data, cuts = ids.tobytes(), (edges * 4).tolist()
            found += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return found


_codes: dict[tuple[str, int], LibraryCodes] = {}


def library_codes(path: str, limit: int = 500_000) -> LibraryCodes:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if (path, limit) not in _codes:
        _codes.clear()
        _codes[path, limit] = LibraryCodes(path, limit)
    return _codes[path, limit]
