"""Near copies by fingerprint, long repeats, near vectors and components against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartwheel.llm import components, repeats, simhash, vectors

random.seed(6)


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    random.shuffle(edges)
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1100)}, 5000: 5000, 5001: 5000}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_equal_brute_force(spark):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(150)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(8):
            c = list(b)
            c[random.randrange(len(c))] = random.choice(vocabulary)
            texts.append(" ".join(c))
    texts += texts[:5] * 3 + [None, "", " \n", "One", "one two", "ONE TWO É", "one two é", "x" * 200_000]
    rows = [(i, t, "q", 0) for i, t in enumerate(texts)] + [(None, texts[0], "q", 0), (3, texts[3], "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    fps = [slow_fingerprint(t or "") for _, t, _, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = union(len(rows), pairs)
    least = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least[root[i]], r[0])
    want = sorted(((r[0], f"{fps[i]:016x}", least[root[i]]) for i, r in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_copies(docs).collect()), key=repr) == want
    assert simhash.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small,dense", [(16, 1024), (2, 4), (2, 2)])
def test_crowded_balls_lose_no_link(spark, monkeypatch, small, dense):
    """Hundreds of fingerprints within few bits of one another, by each way of comparing."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(3)
    values = {0}
    while len(values) < 150:
        v = rng.choice(sorted(values)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.choice(list(range(12)) + [20, 40, 63])
        values.add(v)
    values = sorted(values)
    # the ways of comparing are chosen where tasks run, so they are called here directly
    rows = collections.defaultdict(list)
    width = 16
    for v in values:
        for block in range(4):
            mask = (2**64 - 1) ^ (((1 << width) - 1) << (width * block))
            for flip in [0, *(1 << i for i in range(64) if mask >> i & 1)]:
                rows[block, (v & mask) ^ flip].append(v)
    found = []
    for (block, _), group in rows.items():
        group = np.array(sorted(group), np.uint64)
        if len(group) <= small:
            n = len(group)
            for a, b in simhash._small_groups(group, np.zeros(n, int), np.full(n, n)):
                found += zip(a.tolist(), b.tolist())
        elif len(group) <= dense:
            a, b = simhash._dense_group(group)
            found += zip(a.tolist(), b.tolist())
        else:
            for a, b in simhash._large_group(group, block):
                found += zip(a.tolist(), b.tolist())
    place = {v: i for i, v in enumerate(values)}
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found) or dense >= small
    want = union(len(values), [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 3])
    assert union(len(values), [(place[a], place[b]) for a, b in found]) == want


# ---- long repeats ---------------------------------------------------------------------

def by_hand(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[s:s + length] for r in raws for s in range(len(r) - length + 1))
    found = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if seen[r[s:s + length]] > 1:
                gone[s:s + length] = True
        gone = gone[:len(r)]
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        found.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


def repeat_texts():
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(2, 7)))
    free = lambda n: " ".join(word() for _ in range(n))
    passages = [free(30), free(25), free(60)]
    texts = [None, "", "short", "a" * 900, "ab" * 300 + "x" + "ab" * 250, free(200)]
    for _ in range(25):
        texts.append(free(random.randint(5, 40)) + random.choice(passages) + free(random.randint(0, 40)))
    texts += [texts[8]] * 4 + [texts[9][:-3] + "zzz", texts[9] + free(20), passages[2], free(5) + passages[2][:130], passages[2][1:131]]
    return texts


@pytest.mark.parametrize("length,gram,group", [(120, 40, 2048), (120, 40, 2), (100, 96, 2048)])
def test_long_repeats_equal_brute_force(spark, monkeypatch, length, gram, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = repeat_texts()
    rows = [(None if i == 5 else i, t, 1, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int, key string").repartition(3)
    want = sorted(((r[0], *x) for r, x in zip(rows, by_hand(texts, length))), key=repr)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs, length).collect()), key=repr)
    assert got == want
    assert repeats.remove_repeats(docs.limit(0), length).count() == 0


def test_index_statistics_equal_brute_force():
    for trial in range(40):
        n = random.choice([1, 2, 7, 40, 150])
        data = bytes(random.choice(b"ab" if trial % 2 else b"abcd") for _ in range(n)) * (3 if trial % 5 == 0 else 1)
        text = np.frombuffer(data, np.uint8)
        assert repeats.suffix_order(text).tolist() == sorted(range(len(data)), key=lambda i: data[i:])

        def common(i, j):
            k = 0
            while max(i, j) + k < len(data) and data[i + k] == data[j + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(len(data)) if j != i), default=0) for i in range(len(data))]
        index = repeats.RunIndex(text)
        assert index.matching_statistics().tolist() == want
        assert len(index.run_start) == 1 + sum(a != b for a, b in zip(index_bytes(data), index_bytes(data)[1:]))


def index_bytes(data):
    return [data[i - 1] if i else -1 for i in sorted(range(len(data)), key=lambda i: data[i:])]


# ---- vectors --------------------------------------------------------------------------

def test_near_vectors_find_nearly_all_links_and_no_other(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(900, 24))
    for centre in range(40):                                    # neighbours on both sides of the threshold
        for j in range(6):
            points[100 + centre * 6 + j] = points[centre] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])
    points[600:700] = points[5]
    points[700:780] = points[6] + rng.normal(size=(80, 24)) * 0.05
    rows = [(i, p.astype(np.float32).tolist(), 1, "x") for i, p in enumerate(points)]
    extra = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [1.0] * 3), (None, rows[5][1]),
             (2006, [float("inf")] * 24), (2007, (points[5] * 3).astype(np.float32).tolist())]
    rows += [(i, v, 1, "x") for i, v in extra]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int, node string").repartition(5)
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    usable = [(i, np.array(v, float)) for i, v, *_ in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in usable])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    degree = {i: int(n) for (i, _), n in zip(usable, near.sum(axis=1))}
    assert all(got[i].n_links <= n for i, n in degree.items())
    assert sum(got[i].n_links for i in degree) >= 0.9 * sum(degree.values())
    for i in range(2000, 2007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[600].component_id <= 5 and got[None].component_id == got[5].component_id and got[2007].component_id == got[5].component_id
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("members,visitors", [(7, 5), (2048, 16384)])
def test_crowded_cells_are_dealt_out(spark, monkeypatch, members, visitors):
    monkeypatch.setattr(vectors, "MEMBERS", members)
    monkeypatch.setattr(vectors, "VISITORS", visitors)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1, 8)) + rng.normal(size=(60, 8)) * 0.01
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in vectors.near_vectors(frame).collect()} == {(i, 59, 0, i == 0) for i in range(60)}


def test_long_texts_are_read_in_parts_with_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, 60_000).astype(np.uint8), rng.integers(97, 99, 20_000).astype(np.uint8), np.full(5_000, 97, np.uint8), rng.integers(0, 256, 400).astype(np.uint8)]
    texts.append(np.tile(texts[0][:700], 20))
    for length in (50, 150, 400):
        for data in texts:
            monkeypatch.setattr(repeats, "BUFFER", 10**9)
            want = repeats.anchors_of(data, length)
            for size in (97, 1000, 4096, len(data) - length):
                if size < 1 or len(data) // size > 700:
                    continue
                monkeypatch.setattr(repeats, "BUFFER", size)
                assert all(np.array_equal(a, b) for a, b in zip(repeats.anchors_of(data, length), want))


def test_anchors_of_a_long_text_take_bounded_memory():
    import tracemalloc

    data = np.random.default_rng(5).integers(0, 256, 12_000_000).astype(np.uint8)
    repeats.anchors_of(data[:1_200_000], 400)            # tables of powers
    tracemalloc.start()
    repeats.anchors_of(data, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)                         # one array of 8 bytes a byte of the text would be half of it
