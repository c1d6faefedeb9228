"""Quality rules, toxicity and personal data."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.llm import pii, quality, toxicity
from cartwheel.llm.common import held_out, held_out_column

random.seed(5)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def quality_docs(spark):
    free = lambda n: " ".join("".join(random.choice("abcdé😀") for _ in range(random.randint(1, 8))) for _ in range(n))
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "x y z x y z", free(49), free(50), free(400), "a b c d\n" * 30, "one line\n\n\none line\n one line\none line",
             free(60) + " $$$ %%% ###", "  a b \x1c c", "w " * 5000, free(3000), " lead", "trail ", "a\r\nb\r\na\r\nb"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(3, 60))) for _ in range(40)]
    prose = lambda n: " ".join(random.choice(["the", "of", free(1), free(1), free(1)]) for _ in range(n))
    texts += [prose(120), "\n".join(prose(9) for _ in range(12)), "\n".join(prose(9) + random.choice([" ...", "\u2026", "... "]) for _ in range(12)), prose(60) + " " + " ".join(str(10**7 + i) for i in range(90)),
              (prose(7) + " ") * 4 + prose(300), " ".join([prose(40)] * 6)]
    rows = [(None if i == 2 else i % 50, t, 5, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, _text string")


def test_figures_equal_plain_loops(spark):
    docs = quality_docs(spark)
    want = sorted(((r.doc_id, *figures(r.text or "")) for r in docs.collect()), key=repr)
    judged = quality.judge(docs)
    rows = judged.collect()
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == want
    assert all(not (r.kept and r.base_failed) for r in rows) and any(r.kept for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


def test_verdicts_do_not_depend_on_the_order_of_rules(spark):
    docs = quality_docs(spark)
    rules = quality.default_rules()
    kept = lambda some: sorted((r.doc_id or -1, r.n_words, r.kept) for r in quality.judge(docs, some).collect())
    assert kept(rules) == kept(rules[::-1])
    measured = quality.order_rules(docs, rules, 20)
    rates = [share / cost for _, share, cost in measured]
    rejecting = {r.name for r in rules if docs.transform(lambda d: quality.with_figures(d, keep=True)).filter(~quality.base_failed() & r.rejects).count()}
    assert {"few_letters", "no_prose", "open_lines"} <= rejecting
    assert rates == sorted(rates, reverse=True) and {m[0].name for m in measured} == {r.name for r in rules}


def test_a_rule_is_not_evaluated_for_rows_that_are_rejected_before(spark):
    docs = quality_docs(spark)
    trap = quality.Rule("trap", F.length(F.raise_error(F.concat(F.lit("seen "), F.substring("_text", 1, 9)))) > 0)
    n = F.col("n_words")
    first = quality.Rule("first", n >= 50)
    # rows below fifty words are the base rules', the others the first rule's; nothing is left for the trap
    cascade = quality.cascade([quality.Rule("base", quality.base_failed()), first, trap])
    seen = quality.with_figures(docs, keep=True).select("n_words", quality.base_failed().alias("base"), cascade.alias("by")).collect()
    assert {r.by for r in seen} == {"base", "first"} and all(r.by == ("base" if r.base else "first") for r in seen)
    with pytest.raises(Exception, match="seen"):
        quality.with_figures(docs, keep=True).select(quality.cascade([trap, first])).collect()


def test_figures_of_the_rules_equal_plain_loops(spark):
    docs = quality_docs(spark)
    t, w = F.col("_text"), F.col("_words")
    found = quality.with_figures(docs, keep=True).select(
        "_text", quality.letters(t).alias("a"), quality.frequent_words(w).alias("b"), quality.open_lines(t).alias("c"), quality.distinct_windows(w).alias("d")).collect()
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r._text)
        lines = [x for x in r._text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.a == sum(ch.isalpha() for ch in r._text) and r.b == sum(x in quality.FREQUENT for x in words)
        assert r.c == sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$", x)) for x in lines)
        assert r.d == len({tuple(words[i:i + 5]) for i in range(len(words) - 4)})


def labelled(spark, n=260):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(["zzbad", "qqvile", "xxrude"])
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), int(toxic), 0.5))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int, score double")


def test_toxicity_on_held_out_rows(spark):
    frame = labelled(spark)
    docs, labels = frame.drop("toxic"), frame.select("doc_id", "toxic")
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == held_out(i) for i, r in rows.items())
    test = [i for i in rows if rows[i].held_out]
    assert len(test) > 30 and sum(rows[i].predicted == truth[i] for i in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    # neither the labels of held-out rows nor language, source and id are read
    flipped = labels.withColumn("toxic", F.when(held_out_column(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(docs.withColumn("source", F.lit("s")), flipped).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_toxicity_of_odd_rows(spark):
    frame = labelled(spark, 60)
    odd = [(None, "zzbad", None), (5, None, "en"), (5, None, "en"), (900, "", "xx"), (901, "1 2 3 !!", "de"), (902, "word " * 300_000 + "zzbad", "en")]
    docs = frame.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"))
    rows = toxicity.classify(docs, frame.select("doc_id", "toxic").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))).collect()
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(docs.limit(0), frame.select("doc_id", "toxic")).count() == 0
    assert toxicity.classify(docs, frame.select("doc_id", "toxic").limit(0)).count() == 66


def test_thresholds_and_bias_follow_all_labels_whatever_the_sample(spark):
    frame = labelled(spark, 1200).filter("toxic = 0 or doc_id % 2 = 0").cache()
    docs, labels = frame.drop("toxic"), frame.select("doc_id", "toxic")
    settings = toxicity.Settings(sample_rows=40)
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels, settings).collect()}
    open_rows = [r for r in frame.collect() if not held_out(r.doc_id)]
    net = toxicity.train(docs, labels, settings)
    counts = toxicity.score_counts(toxicity.score(docs, net, settings.rows, ["doc_id", "lang"]), labels)
    assert sum(r["clean"] for r in counts) == sum(r.toxic == 0 for r in open_rows) and sum(r["toxic"] for r in counts) == sum(r.toxic for r in open_rows)
    found = toxicity.thresholds(counts)
    assert set(found) == {None, "en", "de"} and all(rows[r.doc_id].threshold == found[r.lang] for r in open_rows)
    for lang, value in found.items():           # no cut of all labelled rows has fewer wrong
        own = [(rows[r.doc_id].score, r.toxic) for r in open_rows if lang is None or r.lang == lang]
        wrong = lambda t: sum((s >= t) != y for s, y in own)
        assert wrong(value) <= min(wrong(s) for s, _ in own) + 1
    # a sample of half toxic rows is moved to the shares of the labels
    texts, marks, _ = toxicity.training_sample(docs, labels, settings)
    plain = toxicity.fit(texts, marks, settings)
    share, fitted = np.mean([r.toxic for r in open_rows]), marks.mean()
    assert abs(net.out_bias - plain.out_bias - np.log(share / (1 - share) / (fitted / (1 - fitted)))) < 1e-6 and share < 0.3 < fitted


def test_long_texts_do_not_push_others_out_of_the_sample(spark):
    frame = labelled(spark, 90)
    order = [r.doc_id for r in frame.filter(~held_out_column()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    settings = toxicity.Settings(sample_words=12_000)
    for long in (order[:1], order[:3]):
        text = F.when(F.col("doc_id").isin(long), F.repeat(F.lit("word "), 30_000)).otherwise(F.col("text"))
        docs = frame.withColumn("text", text).drop("toxic")
        texts, marks, _ = toxicity.training_sample(docs, frame.select("doc_id", "toxic"), settings)
        assert len(texts) == len(order) - len(long) and set(marks.tolist()) == {0, 1}
    # a class of long texts only keeps one of them
    docs = frame.withColumn("text", F.when(F.col("toxic") == 1, F.repeat(F.lit("word "), 30_000)).otherwise(F.col("text"))).drop("toxic")
    _, marks, _ = toxicity.training_sample(docs, frame.select("doc_id", "toxic"), settings)
    assert marks.sum() == 1 and len(marks) - 1 == sum(i % 3 != 0 for i in order)


def test_blocks_of_a_long_text_change_nothing():
    rng = np.random.default_rng(0)
    net = toxicity.fit([rng.integers(1, 50, (30, 2)) for _ in range(20)], np.arange(20) % 2, toxicity.Settings(rows=64, epochs=2))
    ids = rng.integers(1, 64, (500, 2)).astype(np.int32)
    assert all(abs(toxicity.score_ids(net, ids) - toxicity.score_ids(net, ids, b)) < 1e-6 for b in (1, 7, 100))


def test_scores_equal_a_convolution_in_plain_loops():
    rng = np.random.default_rng(4)
    net = toxicity.fit([rng.integers(1, 50, (12, 2)) for _ in range(20)], np.arange(20) % 2, toxicity.Settings(rows=64, epochs=2))
    for n in (0, 1, 2, 3, 9):
        ids = rng.integers(1, 64, (n, 2)).astype(np.int32)
        words = [net.embedding[a] + net.embedding[b] for a, b in ids.tolist()]
        words += [np.zeros(8, np.float32)] * (2 if n else 3)
        odds, at = net.out_bias, 0
        for filters in net.filters:
            width, dims, count = filters.shape
            for k in range(count):
                sums = [sum(filters[o, d, k] * words[i + o][d] for o in range(width) for d in range(dims)) for i in range(len(words) - width + 1)]
                odds += float(net.out[at]) * (max(sums) + float(net.bias[at]))
                at += 1
        for block in (1, 2, 5, 1 << 17):
            assert abs(toxicity.score_ids(net, ids, block) - 1 / (1 + np.exp(-odds))) < 1e-5


def test_a_repeated_id_has_few_rows_in_the_sample(spark):
    frame = labelled(spark, 60)
    one = frame.filter(~held_out_column()).first().doc_id
    more = spark.range(500).select(F.lit(one).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int"))).alias("text"), F.lit("en").alias("lang"))
    docs = frame.filter(F.col("doc_id") != one).select("doc_id", "text", "lang").union(more)
    texts, marks, _ = toxicity.training_sample(docs, frame.select("doc_id", "toxic"))
    plain, _, _ = toxicity.training_sample(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    assert len(texts) == len(plain) + toxicity.Settings().id_rows - 1


# ---- personal data ----------------------------------------------------------------------

# fixed values: the patterns as they are given
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    parts = ["a@b.co", "x.y+z@a-b.c.d", "@x.y", "a@b@c.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (456) 555-2186", "+12345678901234567", "+4", "12", "é", "😀", "..", "--", "%", "user@", "@", "+", "(", "9" * 30, "0.0.0.0", "a.b@c.d.e@f.g"]
    for _ in range(3000):
        text = "".join(random.choice(parts) + random.choice(["", " ", ",", "\n", "-", "."]) for _ in range(random.randint(1, 8)))
        assert [(a, k, b) for a, b, k in pii.base_spans(text)] == slow_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def secret_docs(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(200):
        text = "plain words chapter 12 and year1999edition of model2000x " * 3
        if i % 4 == 0:
            text += f" password={hexes(18)} and"
        if i % 4 == 1:
            text += f' token = "{hexes(40)}" then'
        if i % 10 == 2:
            text += " AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)) + " mail a.b@c.org"
        rows.append((i, text, "x", 3))
    rows += [(None, "mail me@x.org", "x", 3), (4, None, "x", 3), (4, None, "x", 3), (900, "", "x", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, votes int")


def test_spans_are_added_and_base_ones_stay(spark):
    docs = secret_docs(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.find(docs).collect()
    assert len(rows) == 204
    for r in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in slow_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        if r.doc_id is not None and r.doc_id < 200:
            assert r.n_secret == int(r.doc_id % 4 in (0, 1) and r.doc_id != 4 or r.doc_id % 10 == 2) + int(r.doc_id % 4 in (0, 1) and r.doc_id % 10 == 2) or r.doc_id == 4
    assert pii.find(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = secret_docs(spark)
    rows = pii.redact(docs)
    assert rows.schema == docs.schema
    texts = [r.text for r in rows.collect()]
    assert texts.count(None) == 2 and "mail [EMAIL]" in texts and not any("password=0" in (t or "") or EMAIL.search(t or "") for t in texts)
    assert sum("[SECRET]" in (t or "") for t in texts) >= 100
    assert pii.masked("abcdef", [(1, 3, 0), (2, 5, 1)]) == "a[EMAIL]f"


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(3)
    counts = collections.Counter()
    for _ in range(4000):
        truth = rng.random() < 0.3
        rate = [(0.9, 0.05), (0.8, 0.1), (0.85, 0.02), (0.5, 0.5), (0.7, 0.1)]
        counts[sum(1 << i for i, (hit, miss) in enumerate(rate) if rng.random() < (hit if truth else miss))] += 1
    table, prior, posterior = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05 and abs(table[0, 1] - 0.9) < 0.05 and abs(table[3, 1] - table[3, 0]) < 0.1
    assert posterior[31] > 0.95 and posterior[0] < 0.05


def test_reliabilities_equal_plain_loops():
    rng = random.Random(9)
    counts = {p: rng.randint(1, 40) for p in range(2 ** pii.LABELERS) if rng.random() < 0.7}
    table, prior, posterior = pii.reliabilities(counts, 7)
    bits = {p: [p >> i & 1 for i in range(pii.LABELERS)] for p in counts}
    belief = {p: min(max(sum(b) / pii.LABELERS, 0.05), 0.95) for p, b in bits.items()}
    for _ in range(7):
        share = sum(counts[p] * belief[p] for p in counts) / sum(counts.values())
        chance = []
        for i in range(pii.LABELERS):
            clean = sum(counts[p] * (1 - belief[p]) * bits[p][i] for p in counts) + 0.5
            private = sum(counts[p] * belief[p] * bits[p][i] for p in counts) + 0.5
            chance.append((clean / (sum(counts[p] * (1 - belief[p]) for p in counts) + 1), private / (sum(counts[p] * belief[p] for p in counts) + 1)))
        for p in counts:
            clean, private = 1 - share, share
            for i in range(pii.LABELERS):
                clean *= chance[i][0] if bits[p][i] else 1 - chance[i][0]
                private *= chance[i][1] if bits[p][i] else 1 - chance[i][1]
            belief[p] = private / (clean + private)
    assert np.allclose(table, chance) and abs(prior - share) < 1e-9
    assert all(abs(posterior[p] - belief[p]) < 1e-9 for p in counts)
