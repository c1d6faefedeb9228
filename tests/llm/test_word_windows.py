"""Windows of words that occur before, against plain loops; the index against direct search."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from cartwheel.llm import fm_index, sql, word_windows as W


def test_bits_and_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = rng.integers(0, 2, n).astype(np.uint8)
        assert fm_index.Bits(bits).ones(np.arange(n + 1)).tolist() == np.append(0, np.cumsum(bits)).tolist()
    for size in (1, 2, 3, 17, 300):
        symbols = rng.integers(0, size, 500)
        tree = fm_index.WaveletMatrix(symbols, size)
        at, symbol = rng.integers(0, 501, 400), rng.integers(0, size, 400)
        assert tree.rank(symbol, at).tolist() == [int((symbols[:a] == s).sum()) for a, s in zip(at, symbol)]


@pytest.mark.parametrize("seed,words,length", [(0, 2, 3), (1, 3, 4), (2, 8, 2), (3, 50, 5), (4, 1, 4), (5, 4, 20)])
def test_matching_statistics_equal_direct_search(seed, words, length):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, words, int(rng.integers(1, 40))) for _ in range(12)]
    values = [rng.permutation(1000)[:len(t)] for t in texts]
    index = fm_index.WordIndex(texts, values, words, length)
    patterns = [*texts[:4], *(rng.integers(0, words + 1, int(rng.integers(0, 30))) for _ in range(15))]       # ``words`` is in no text
    found, least = index.matching_statistics(patterns)
    said = [t.tolist() for t in texts]
    for pattern, lengths, smallest in zip(patterns, found, least):
        p = pattern.tolist()
        for i in range(len(p)):
            here = lambda n: [int(v[j]) for t, v in zip(said, values) for j in range(len(t) - n + 1) if t[j:j + n] == p[i:i + n]]
            longest = max(n for n in range(len(p) - i + 1) if n == 0 or here(n))
            assert lengths[i] == longest
            assert smallest[i] == (min(here(length)) if longest >= length else np.iinfo(np.int64).max)


def test_words_are_found_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice([" ", "\n", "\t", "\x0b", "a", "bc", "é", "　", "\x1c", "x" * 40]) for _ in range(3000)).encode()
    whole = W.word_codes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(W, "PART", 7)
    codes, starts = W.word_codes(np.frombuffer(text, np.uint8))
    assert starts.tolist() == [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] == whole[1].tolist()
    assert (codes == whole[0]).all() and len(set(codes.tolist())) == len(set(text.split()))


def plain(rows, length):
    """(id, words, removed, digest) of rows (id, text), in the order given for equal ids."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, found = set(), []
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            window = tuple(words[at:at + length])
            if window in seen:
                gone[at:at + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        found.append((rows[i][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=repr)


def corpus(rng, n, words=30):
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "日本　語", "\x1c"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    line, passages = make(34), [make(rng.randint(15, 70)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        words = make(rng.randint(0, 80))
        if kind < 2:                                # one line in many texts, at changing places
            words = words[:rng.randint(0, 40)] + line + make(rng.randint(0, 30))
        elif kind == 2:
            words = words + rng.choice(passages)[rng.randint(0, 5):] + make(3)
        elif kind == 3 and rows:                    # a near copy
            words = (rng.choice(rows)[1] or "").split(" ")
            if words:
                words[rng.randrange(len(words))] = "changed"
        elif kind == 4:
            words = make(rng.randint(1, 3)) * rng.randint(1, 40)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(rng.choice([3, 900, None]), t) for _, t in rng.sample(rows, 25)]
    rows += [(901, None), (902, ""), (903, " \n"), (904, " ".join(make(20))), (None, " ".join(make(19))), (905, " ".join(make(30)) + " " + "same " * 6000)]
    return rows


@pytest.mark.parametrize("length,kinds,shard", [(20, 4096, 250_000), (20, 2, 300), (20, 1, 60), (12, 3, 100), (6, 2, 50)])
def test_removal_equals_plain_loops(spark, monkeypatch, length, kinds, shard):
    monkeypatch.setattr(W, "MOST_KINDS", kinds)
    monkeypatch.setattr(W, "INDEX_WORDS", shard)
    monkeypatch.setattr(W, "PART", 50)
    rng = random.Random(length * 100 + kinds)
    rows = corpus(rng, 220, 6 if length < 20 else 30)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, row int, n_words string").coalesce(1)
    found = W.remove_windows(frame, length, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert sorted((tuple(r)[:4] for r in found), key=repr) == plain(rows, length)
    assert sum(r.n_removed for r in found) > 1000


def test_windows_of_one_shard():
    a = " ".join(f"a{i}" for i in range(25)).encode()
    assert W.judge_shard([(1, 50, 100, a), (1, 50, 400, a), (2, 4, 0, b"x " + a[:-4])], 20) == [
        (50, 100, 104), (50, 400, 405)]


def test_an_empty_table_gives_an_empty_table(spark):
    assert W.remove_windows(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert [tuple(r) for r in W.remove_windows(spark.createDataFrame([(None, None)], "doc_id bigint, text string")).collect()] == [
        (None, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_sql_equals_plain_loops():
    rows = corpus(random.Random(8), 120)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(connection.execute(sql.OP12).fetchall(), key=repr) == plain(rows, 20)
