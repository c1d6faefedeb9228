"""Alignment of two tokenizers against the libraries and plain loops."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cartwheel.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ATOMS = [" ", "\n", "  ", "\n\n", "a", "the", ".", ",", "é", "\t", "\r", "\xa0", "　", "▁", "<|endoftext|>", "<s>", "日本", "😀", "'s", "7", "\x1c",
         "​", "()", ";\r", "word", "².", "Él", "don't", " foo", " bar", "#" * 30]


class Plain:
    """Both libraries on whole texts, and loops over all tokens."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
        self.bytes_a = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, start, end)] of both sides; nothing where the bytes do not come back."""
        if not text:
            return [], []
        found = []
        for ids, spell in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a), (self.b.encode(text), self.bytes_b)):
            side, at = [], 0
            for i in ids:
                side.append((i, at, at + len(spell(i))))
                at = side[-1][2]
            if b"".join(map(spell, ids)) != (" " + text).encode():
                return [], []
            found.append(side)
        return found

    def align(self, text):
        """(tokens A, tokens B, groups, [(id A, id B)], group text)"""
        a, b = self.tokens(text)
        links, groups, j = [], [], 0
        for x, start, end in a:
            while b[j][2] <= start:
                j += 1
            at = j
            while at < len(b) and b[at][1] < end:
                links.append((x, b[at][0]))
                at += 1
        ends = {e for *_, e in a} & {e for *_, e in b}
        i = j = 0
        for end in sorted(ends):
            left, right = [], []
            while i < len(a) and a[i][2] <= end:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                right.append(str(b[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        return len(a), len(b), len(groups), links, ";".join(groups)


def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    return ["", "a", " ", "  ", "\n", " a", "a ", "\nfoo", "foo\n", "▁a", "x" * 700, "日本語" * 200, " ".join(["word", "Él,"] * 2000), " " * 300, "a\n. b", "a\n, ", *made]


def test_stretches_equal_whole_texts():
    both, plain, some = alignment.Both(*PATHS, limit=700), Plain(), texts()      # the memory is emptied many times
    assert both.by_stretch
    for at in range(0, len(some), 40):
        part = some[at:at + 40]
        rows, sizes = both.rows(part)
        stops = np.cumsum(sizes)
        for text, a, b in zip(part, stops - sizes, stops):
            mine = rows[a:b]
            links = sorted((int(x) >> 32, int(x) & (2**32 - 1)) for x in both.pairs.take(mine)[0])
            n_a, n_b, groups, want, said = plain.align(text)
            assert both.numbers[mine].sum(axis=0).tolist() == [n_a, n_b, groups, len(want)], text
            assert links == sorted(want) and b";".join(both.texts[i] for i in mine) == said.encode()


def test_a_whole_text_is_one_stretch_where_files_do_not_part_at_blanks():
    both, plain = alignment.Both(*PATHS), Plain()
    both.by_stretch = False
    for text in texts()[:300]:
        rows, sizes = both.rows([text])
        n_a, n_b, groups, links, said = plain.align(text)
        assert both.numbers[rows].sum(axis=0).tolist() == [n_a, n_b, groups, len(links)]
        assert b";".join(both.texts[i] for i in rows) == said.encode()


@pytest.mark.parametrize("seed", range(6))
def test_gallop_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    short, long, short_cuts, long_cuts, base = [], [], [0], [0], 0
    for _ in range(30):
        total = int(rng.integers(1, 400 if seed < 5 else 40_000))
        sides = [np.unique(np.append(rng.integers(1, total + 1, int(rng.integers(0, total + 1))), total)) + base for _ in range(2)]
        near, far = sorted(sides, key=len)
        short, long = short + near.tolist(), long + far.tolist()
        short_cuts.append(len(short))
        long_cuts.append(len(long))
        base += total
    short, long, short_cuts, long_cuts = map(np.array, (short, long, short_cuts, long_cuts))
    place = alignment.gallop(short, short_cuts, long, long_cuts)
    assert place.tolist() == np.searchsorted(long, short).tolist()
    first, last, shared = alignment.overlaps(short, short_cuts, long, long_cuts)
    starts = np.append(0, short[:-1])
    long_starts = np.append(0, long[:-1])
    for i in range(0, len(short), max(1, len(short) // 400)):
        touched = np.flatnonzero((long > starts[i]) & (long_starts < short[i]))
        assert (first[i], last[i]) == (touched[0], touched[-1]) and shared[i] == (short[i] in set(long.tolist()))


def test_ranks_stand_for_the_file_only_where_merges_are_in_order():
    side = alignment.ByteLevel(PATHS[0])
    assert side.ranked is not None
    some = texts()
    fast = side.codes(some)
    side.ranked = None
    assert fast == side.codes(some)


def test_corpus_counts_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 400)              # many blocks
    some = [None, *texts()[:300], "same text.", "same text.", texts()[12]]
    rows = [(None if i % 50 == 3 else i // 2, t, 7, "x") for i, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_a int, pair string").repartition(3)
    plain = Plain()
    aligned = [(i, *plain.align(t)) for i, t, *_ in rows]
    counts = collections.Counter(link for *_, links, _ in aligned for link in links)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(i, n_a, n_b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(said.encode()).hexdigest() if n_a else "") for i, n_a, n_b, g, links, said in aligned]
    found = alignment.align(docs, *PATHS)
    assert found.columns == [c.split()[0] for c in alignment.ALIGNED.split(", ")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.align(docs.limit(0), *PATHS).collect() == []


def test_keys_of_long_blocks_take_bounded_memory():
    import tracemalloc

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(2000)]           # 4,000,000 characters, 1,000,000 words
    both = alignment.Both(*PATHS)
    both.rows(texts[:5])
    tracemalloc.start()
    rows, sizes = both.rows(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == sizes.sum() >= 1_000_000
    assert peak < 10 * 4_000_000                        # a string for every word at once would be half as much again, their lists not counted


def test_workers_remember_no_stretches_after_a_task(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text").repartition(4)
    assert alignment.align(docs, *PATHS).count() == 40

    def held(batches):
        import pyarrow as pa

        from cartwheel.llm import alignment as there

        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(b.known) for b in there._both.values()) for _ in batches], pa.int64())})

    assert spark.range(0, 40, 1, 4).mapInArrow(held, "n bigint").groupBy().sum("n").first()[0] == 0
