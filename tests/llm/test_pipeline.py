"""The pipeline, stage by stage, against brute force on what each stage gets."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
from mix_by_hand import mix_by_hand, targets_by_hand

import corpus_pipeline as C
from cartwheel.llm import queries, simhash

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(320):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(["zzbad", "qqvile", "xxrude"])
        elif i % 9 == 1:
            text[rng.randrange(len(text))] = f"mail{i}@host.example.org"
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), "big" if rng.random() < 0.4 else rng.choice(["a", "b", None]), 1, "extra"))
        if i % 3 != 2:
            labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[k][1], "en", "a", 1, "extra") for k in range(12)]                                 # exact copies
    rows += [(2000 + k, clean[k][1].replace(" ", "\n", 1).upper(), "en", "b", 1, "extra") for k in range(12)]   # other case and space
    rows += [(3000, None, "en", "a", 1, "extra"), (None, "no id here", None, None, None, None), (3001, "", "en", "b", 1, "extra")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """What each stage returned, with its input, as lists of rows."""
    base = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES:
        result = stage(spark, docs, folder)
        result.write.parquet(f"file://{base}/{name}")
        result = spark.read.parquet(f"file://{base}/{name}")
        found[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return found


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_columns_and_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_copies", "personal_data", "source_mix", "byte_bpe"]


def test_toxic_texts_go_and_clean_ones_stay(outputs):
    before, after, columns = outputs["toxicity"]
    assert columns == C.COLUMNS
    is_toxic = lambda r: bool(set((r.text or "").lower().split()) & {"zzbad", "qqvile", "xxrude"})
    assert sorted(map(key, after)) == sorted(key(r) for r in before if not is_toxic(r))


def test_one_of_each_group_stays(outputs):
    before, after, columns = outputs["simhash_near_copies"]
    assert columns == C.COLUMNS
    fps = np.array([simhash.fingerprint(r.text or "") for r in before], np.uint64)
    parent = list(range(len(before)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(before)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(before):
        if r.doc_id is not None:
            least[find(i)] = min(least[find(i)], r.doc_id)
    want = [r for i, r in enumerate(before) if r.doc_id is None or r.doc_id == least[find(i)]]
    assert sorted(map(key, after)) == sorted(map(key, want)) and len(after) < len(before) - 20


def test_one_of_repeated_rows_and_of_null_ids_stays(spark):
    text = lambda seed: " ".join(random.Random(seed).choice(["red", "blue", "ship", "tree", "walks", "home", "late", "cloud"]) + str(seed) for _ in range(60))
    rows = [(5, text(1), "en", "a", 1)] * 3 + [(6, text(1), "en", "a", 1), (None, text(1), "en", "a", 1)]        # a group with a repeated smallest row
    rows += [(7, text(2), "en", "b", 1), (7, text(2), "de", None, 2), (7, text(3), None, "a", 1)]                 # an id with other columns and another text
    rows += [(None, text(4), "en", "a", None)] * 4 + [(None, text(5), None, None, 1), (None, None, "en", "a", 1), (None, "", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    found = C.near_copies(spark, docs, "").select(*C.COLUMNS).collect()
    assert sorted(((r.doc_id, r.text or "") for r in found), key=repr) == sorted(
        [(5, text(1)), (7, text(2)), (7, text(3)), (None, text(4)), (None, text(5)), (None, "")], key=repr)
    assert all(tuple(r) in rows for r in found)
    again = C.near_copies(spark, docs.repartition(3), "").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_personal_data_is_replaced(outputs):
    before, after, columns = outputs["personal_data"]
    assert columns == C.COLUMNS
    want = sorted((key(r)[:2], EMAIL.sub("[EMAIL]", r.text) if r.text is not None else None) for r in before)
    assert sorted((key(r)[:2], r.text) for r in after) == want and any("[EMAIL]" in (t or "") for _, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_sources_come_near_their_targets(outputs):
    before, after, columns = outputs["source_mix"]
    assert columns == C.COLUMNS
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes = collections.Counter()
    for r in before:
        sizes[r.source] += size(r)
    given = [(r.doc_id, r.source, size(r)) for r in before]
    want = collections.Counter()
    for r, taken in zip(before, mix_by_hand(given, targets_by_hand(sizes), whole=True)):
        if taken:
            want[key(r)] += taken // size(r)
    assert collections.Counter(map(key, after)) == want


def test_the_mix_is_encoded_and_comes_back(outputs):
    before, after, _ = outputs["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for r in before:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()), ids))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in after), key=repr) == sorted(want, key=repr)


def test_run_is_the_stages_in_order(spark, folder, outputs):
    assert sorted(map(repr, C.run(spark, folder).collect())) == sorted(map(repr, outputs["byte_bpe"][1]))


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)
