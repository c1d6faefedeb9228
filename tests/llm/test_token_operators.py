"""Token counts, byte pairs, token files and mixing against the libraries and plain loops."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mix_by_hand import mix_by_hand, targets_by_hand

from cartwheel.llm import bpe, mixing, queries, token_counts, token_files, wordmemo

random.seed(4)
ODD = [None, "", " ", "a", "  a", "a  b", "a\n\nb", "x<|endoftext|>y", "<|startoftext|> hi", "Ünï cödé ×÷ µ", "a\tb\r\nc", "\nabc", "abc\n",
       " abc ", "don't I'll 12 3.4, x...", "日本語 テスト", "It's ÀÉ. ß,", "a.,b ,c ***, d", "é x", "ﬁ Σας ΑΣ", "x\x1c\x1dy᠎ z​",
       "😀😀 emoji👩‍👩‍👧", "#" * 700, "a" * 3000, " " * 600 + "b", "".join(random.choice("abcdeth") for _ in range(1500)),
       " ".join(random.choice(["the", "Of", "and,", "thring.", "éta"]) for _ in range(20000)), "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i // 2 if i > 26 else i, t, "x", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int").repartition(3)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_counts_equal_the_library_and_the_cache_is_used(spark, docs, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    want = sorted(((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in plain(docs)), key=repr)
    for _ in range(2):
        assert sorted((tuple(r) for r in token_counts.count_tokens(docs, path, cache).collect()), key=repr) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in ODD})       # the second run appended nothing
    # what the cache says counts: it is joined, not computed again
    version = token_counts.tokenizer_version(path)
    fresh = f"file://{tmp_path}/fresh"
    spark.createDataFrame([(bytearray(hashlib.sha256(b"same").digest()), 77)], token_counts.CACHE_SCHEMA).write.parquet(f"{fresh}/version={version}")
    found = token_counts.count_tokens(docs.filter("text = 'same'"), path, fresh)
    assert [r.n_tokens for r in found.collect()] == [77, 77]


def test_byte_pairs_equal_the_library_and_come_back(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, path, P.PATTERN)
    decoded = bpe.decode_documents(encoded, path, P.PATTERN)
    want = sorted((i, t.encode(), library.encode_ordinary(t)) for i, t in plain(docs) if i is not None)
    assert sorted((r.doc_id, bytes(r.data), r.ids) for r in decoded.collect() if r.doc_id is not None) == want
    digest = {r.doc_id: r for r in bpe.round_trip_digests(encoded, path, P.PATTERN).collect()}
    for i, data, ids in want:
        if i < 13:
            assert digest[i].n_tokens == len(ids) and digest[i].decoded_sha256 == hashlib.sha256(data).hexdigest()
            assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_spaced_stops_and_random_texts_equal_both_libraries():
    rng = random.Random(21)
    texts = ["foo , bar", "wait . . . what", " . . . ", "a .\nb", " , x", "\n, b", ". a", "a. , b", "a , . b", "a, . b.\n, c .", ".", " .\n", "one ,\n. two , 3 . 5 ."]
    texts += ["".join(rng.choice(" \n.,ab") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice([" ", "\n", ".", ",", " .", " ,", "word", "é", "7", "'s", "!", "\""]) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, own = Tokenizer.from_file(P.path(name)), wordmemo.LibraryCodes(P.path(name))
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert [t for t, a, b in zip(texts, own.encode(texts), want) if a != b] == []
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = [x.tolist() for x in bpe.BytePairs(path, P.PATTERN).encode(texts)]
    assert [t for t, a in zip(texts, found) if a != library.encode_ordinary(t)] == []
    assert sum(wordmemo.is_plain(t) for t in texts) > 1000


def test_a_full_memory_keeps_common_words_and_changes_no_code():
    rng = random.Random(5)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    texts = [" ".join([rng.choice(common) if rng.random() < 0.7 else "".join(rng.choices("abcdefg", k=6)) for _ in range(30)]) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, own = Tokenizer.from_file(P.path(name)), wordmemo.LibraryCodes(P.path(name), limit=300)
        found = [code for at in range(0, 300, 10) for code in own.encode(texts[at:at + 10])]
        assert found == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        memo = own.memo
        memo.shrink()
        assert 15 <= len(memo.known) <= 150 and len(memo.cuts) == len(memo.known) + 1 == len(memo.asked) + 1 and memo.cuts[-1] == len(memo.codes)
        assert sum(any(c in k for k in memo.known) for c in common) >= 18


def test_pair_table_finds_every_pair_and_no_other():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    table = bpe.PairTable(pairs, np.arange(len(pairs), dtype=np.int32))
    left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)
    assert (table.ranks(left, right) == np.arange(len(pairs))).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000, dtype=np.uint64), pairs)
    assert (table.ranks((other >> np.uint64(32)).astype(np.int64), (other & np.uint64(2**32 - 1)).astype(np.int64)) == bpe.NONE).all()


def test_codes_pack_and_unpack():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        codes = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(codes)
        found, used = token_files.unpack(control, data, n)
        assert found.tolist() == codes.tolist() and used == len(data) and len(control) == -(-n // 4)
    counts = np.array([3, 0, 8, 1, 5])
    codes = (2.0 ** rng.uniform(0, 32, counts.sum())).astype(np.uint32)
    runs = np.split(codes, np.cumsum(counts)[:-1])
    assert list(zip(*token_files.pack_all(codes, counts))) == [token_files.pack(run) for run in runs]


def test_token_files_give_the_ids_back(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 500)
    path, folder = P.path("word_bpe_49k.json"), f"file://{tmp_path}/files"
    library = Tokenizer.from_file(path)
    known = docs.filter("ids < 27 and doc_id is not null")
    token_files.write_tokens(known, path, folder)
    start, want = 0, []
    for i, t in sorted(plain(known)):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in token_files.read_tokens(spark, folder).collect()) == want
    sums = {r.doc_id: r.ids_crc32 for r in token_files.read_checksums(spark, folder).collect()}
    assert sums == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, _, ids in want}
    assert spark.read.parquet(f"{folder}/codes").count() == len({x for *_, ids in want for x in ids})


def test_token_files_keep_repeated_and_null_ids(spark, docs, tmp_path):
    token_files.write_tokens(docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/all")
    rows = token_files.read_checksums(spark, f"file://{tmp_path}/all").collect()
    assert len(rows) == len(ODD) and [r.start for r in rows if r.doc_id is None] == [0]


def mixture(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w x"] * rng.choice([0, 1, 5, 40, 300])), "big" if rng.random() < 0.4 else rng.choice(["a", "B", "é", None]), 1, "z") for i in range(600)]
    rows += [(None, "no id", "a", 1, "z"), (7, None, "a", 1, "z"), (7, None, "a", 1, "z"), (9, "\t\n", "empty", 1, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")


def test_mix_meets_its_targets(spark):
    docs = mixture(spark)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += count(r.text)
    want = targets_by_hand(sizes)
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.words
        assert r.words <= r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    # the cut is at the budget, and every source is within a document of its target
    assert sum(taken.values()) == sum(int(t) for t in want.values())
    assert all(abs(taken[s] - want[s]) <= 600 for s in sizes)
    served = sorted((r.finish, r.words < r.size) for r in rows if r.finish is not None)
    assert [cut for _, cut in served].count(True) <= 1 and not any(cut for _, cut in served[:-1])
    last = served[-1][0]
    assert all(r.finish <= last for r in rows if r.finish is not None)
    given = [(r.doc_id, r.source, count(r.text)) for r in docs.collect()]
    by_hand = collections.Counter()
    for (i, source, size), n in zip(given, mix_by_hand(given, want)):
        by_hand[i, source, size] += n
    found = collections.Counter()
    for r in rows:
        found[r.doc_id, r.source, r.size] += r.words
    assert +found == +by_hand
    again = sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(repr, rows))
    by_doc = mixing.words_taken(mixed).collect()
    assert len(by_doc) == 603 and all(r.taken <= 2 * r.size for r in by_doc if r.doc_id != 7)


def test_repeated_rows_and_null_ids_keep_a_row_each(spark, tmp_path):
    docs = mixture(spark)
    more = [(3, "same words here", "a", 1, "z")] * 3 + [(None, f"null {i}", "a", 1, "z") for i in range(5)] + [(None, "no source", None, 1, "z")] * 2
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in queries.op3_mixed_sources(spark, f"file://{tmp_path}").collect()]
    assert len(rows) == 604 + len(more) and all(taken <= 2 * size for _, size, *_, taken in rows)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(queries.SQL["op3_mixed_sources"]).fetchall()
    rounded = lambda found: sorted(((i, s, n, round(t, 6), k) for i, s, n, t, k in found), key=repr)
    assert rounded(rows) == rounded(want)


def test_whole_documents_stay_near_the_targets(spark):
    docs = mixture(spark)
    rows = mixing.mix(docs, whole=True).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert all(r.words in (0, r.size) for r in own)
        assert abs(sum(r.words for r in own) - own[0].target) <= 600
    given = [(r.doc_id, r.source, r["size"]) for r in rows if r["pass"] in (0, None)]
    sizes = collections.Counter()
    for _, source, size in given:
        sizes[source] += size
    assert sum(r.words for r in rows) == sum(mix_by_hand(given, targets_by_hand(sizes), whole=True))
    kept = mixing.mix(docs, whole=True, keep=["text"]).collect()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id, r.source].add(r.text)
    assert len(kept) == len(rows) and all(r.text in texts[r.doc_id, r.source] for r in kept)


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.round_trip_digests(bpe.encode_documents(none, path, P.PATTERN), path, P.PATTERN).count() == 0
    token_files.write_tokens(none, P.path("word_bpe_49k.json"), f"file://{tmp_path}/none")
    assert token_files.read_checksums(spark, f"file://{tmp_path}/none").count() == 0
    assert mixing.words_taken(mixing.mix(mixture(spark).limit(0))).count() == 0
