"""A convolutional text classifier in numpy: hashed word embeddings, filters over one to three words, max pooling.

A word's embedding is the sum of two rows, chosen by checksums of its lower-case
letters and of its first four. Filters of each width slide over the whole text,
the largest value of each filter is kept, and a logistic layer turns them into
a score. Labels, language, source and id are
not read by the score; a language only selects the threshold beyond which a
text counts as rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.common import chunks, held_out_column, whole_text

_WORD = re.compile(r"[^\W\d_]+")
WIDTHS = (1, 2, 3)
BINS = 64


class Network(NamedTuple):
    """Weights; ``filters[k]`` has shape (width, dims, count)."""

    embedding: np.ndarray
    filters: tuple
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


class Settings(NamedTuple):
    """``sample_rows`` labelled ids of each class at most, ``id_rows`` rows of an id, and ``sample_words`` words of them in all, are fitted (see ``training_sample``)."""

    rows: int = 1 << 18
    dims: int = 8
    count: int = 8
    sample_rows: int = 3000
    id_rows: int = 4
    sample_words: int = 4_000_000
    epochs: int = 8
    rate: float = 0.05
    seed: int = 11


class Hasher:
    """Text -> two embedding rows for each word, remembered for the worker's lifetime up to a bound."""

    def __init__(self, rows: int, limit: int = 700_000):
        self.rows, self.limit, self.known = rows, limit, {}

    def row(self, text: str) -> int:
        return 1 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (self.rows - 1)

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.limit:
                self.known.clear()
            for word in set(words):
                if word not in self.known:
                    self.known[word] = self.row(word) << 32 | self.row("<" + word[:4])
            found = list(map(self.known.__getitem__, words))
        return np.array(found, "<u8").view("<u4").reshape(-1, 2).astype(np.int32)


def _padded(ids: np.ndarray) -> np.ndarray:
    """At least as long as the widest filter; row 0 stands for no word."""
    return np.concatenate([ids, np.zeros((max(WIDTHS) - 1 if len(ids) else max(WIDTHS), 2), np.int32)])


def _pooled(net: Network, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest activation of each filter over padded rows, and where it is."""
    x = net.embedding[rows[:, 0]] + net.embedding[rows[:, 1]]
    values, places = [], []
    for weights in net.filters:
        n = len(x) - len(weights) + 1
        out = x[:n] @ weights[0]
        for o in range(1, len(weights)):
            out += x[o:o + n] @ weights[o]
        at = out.argmax(axis=0)
        values.append(out[at, np.arange(out.shape[1])])
        places.append(at)
    return np.concatenate(values) + net.bias, places


def score_ids(net: Network, ids: np.ndarray, block: int = 1 << 17) -> float:
    """0 to 1. Long texts go block by block, which overlap by the widest filter, so memory is bounded; only the text's end is padded."""
    rows, over, best = _padded(ids), max(WIDTHS) - 1, None
    for start in range(0, len(rows) - over, block):
        values, _ = _pooled(net, rows[start:start + block + over])
        best = values if best is None else np.maximum(best, values)
    return float(1 / (1 + np.exp(-(best @ net.out + net.out_bias))))


def fit(texts: Sequence[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> Network:
    """Stochastic gradient steps with per-weight rates; gradients flow through the pooled places only.

    Without both classes the network is constant at the share of the label.
    """
    rng = np.random.default_rng(settings.seed)
    embedding = rng.normal(0, 0.02, (settings.rows, settings.dims)).astype(np.float32)
    embedding[0] = 0
    filters = tuple(rng.normal(0, 1 / np.sqrt(w * settings.dims), (w, settings.dims, settings.count)).astype(np.float32) for w in WIDTHS)
    total = settings.count * len(WIDTHS)
    bias = np.zeros(total, np.float32)
    out = (np.abs(rng.normal(0, 0.3, total)) + 0.1).astype(np.float32)
    share = min(max(float(np.mean(labels)) if len(labels) else 0.0, 1e-4), 1 - 1e-4)
    net = Network(embedding, filters, bias, out, float(np.log(share / (1 - share))))
    if len(set(np.asarray(labels).tolist())) < 2:
        return net._replace(out=np.zeros(total, np.float32))
    sums = {"e": np.full(settings.rows, 1e-2, np.float32), "f": [np.full(f.shape, 1e-2, np.float32) for f in filters],
            "b": np.full(total, 1e-2, np.float32), "o": np.full(total, 1e-2, np.float32), "c": 1e-2}
    out_bias = 0.0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(texts)):
            ids = _padded(texts[i])
            values, places = _pooled(net, ids)
            p = 1 / (1 + np.exp(-(values @ out + out_bias)))
            error = np.float32(p - labels[i])
            grad_out = error * values + np.float32(1e-4) * out
            grad_values = error * out
            sums["o"] += grad_out ** 2
            sums["b"] += grad_values ** 2
            sums["c"] += float(error) ** 2
            at = 0
            for k, weights in enumerate(filters):
                part = grad_values[at:at + settings.count]
                at += settings.count
                rows = ids[places[k][None, :] + np.arange(len(weights))[:, None]]          # (width, count, 2)
                grad_filter = embedding[rows].sum(axis=2).transpose(0, 2, 1) * part
                grad_rows = np.repeat((weights.transpose(0, 2, 1) * part[None, :, None])[:, :, None, :], 2, axis=2)
                sums["f"][k] += grad_filter ** 2
                weights -= settings.rate * grad_filter / np.sqrt(sums["f"][k])
                flat = rows.reshape(-1)
                flat_grad = grad_rows.reshape(len(flat), -1)
                np.add.at(sums["e"], flat, (flat_grad ** 2).mean(axis=1))
                np.add.at(embedding, flat, -settings.rate * flat_grad / np.sqrt(sums["e"][flat])[:, None])
            embedding[0] = 0
            out -= settings.rate * grad_out / np.sqrt(sums["o"])
            bias -= settings.rate * grad_values / np.sqrt(sums["b"])
            out_bias -= settings.rate * float(error) / np.sqrt(sums["c"])
    return Network(embedding, filters, bias, out, float(out_bias))


def marked_ids(labels: DataFrame) -> DataFrame:
    """(_id, _toxic) of the labels that are not held out, each once."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter(F.col("_toxic").isNotNull())
    return marked.filter(~held_out_column("_id")).distinct()


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[np.ndarray], np.ndarray, list]:
    """Word rows, labels and languages of a bounded, repeatable sample of the rows that are not held out.

    Whole texts are used; ``sample_rows`` ids of each class are chosen by a hash,
    and ``id_rows`` rows of an id that the documents repeat. If they have more than ``sample_words`` words in all, the longest are left out,
    but of either class the shortest texts up to a tenth of the words, and its
    shortest text of any length, stay.
    """
    marked = marked_ids(labels)
    chosen = [marked.filter(F.col("_toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(settings.sample_rows) for kind in (0, 1)]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", whole_text().alias("text"), lang.alias("lang"))
    picked = rows.join(F.broadcast(chosen[0].union(chosen[1])), F.col("doc_id") == F.col("_id"))        # 2 x sample_rows ids at most
    hashed = hashed_words(picked.select("_id", "_toxic", "lang", "text"), settings.rows)
    own_id = Window.partitionBy("_id", "_toxic").orderBy(F.xxhash64("words"), "words", "lang")
    hashed = hashed.withColumn("_at", F.row_number().over(own_id)).filter(F.col("_at") <= settings.id_rows).drop("_at")
    # running totals in one place over the bounded sample
    words = F.octet_length("words") / 8
    short = Window.orderBy(words, F.xxhash64("_id"), "_id", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("_toxic").orderBy(words, F.xxhash64("_id"), "_id", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = cut(hashed).withColumn("_to", F.sum(words).over(short)).withColumn("_own", F.sum(words).over(own))
    fits = (F.col("_to") <= settings.sample_words) | (F.col("_own") <= settings.sample_words / 10) | (F.col("_own") == words)
    found = sized.filter(fits).orderBy(F.xxhash64("_id"), "_id", "words", "_toxic")
    texts, marks, langs = [], [], []
    for row in found.select("words", "_toxic", "lang").toLocalIterator():
        texts.append(np.frombuffer(bytes(row["words"]), "<i4").reshape(-1, 2))
        marks.append(row["_toxic"])
        langs.append(row["lang"])
    return texts, np.array(marks, np.int64), langs


def hashed_words(rows: DataFrame, n_rows: int) -> DataFrame:
    """(_id, _toxic, lang, words binary)"""
    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n_rows)
        for batch, texts in chunks(batches, "text"):
            words = [hasher(t).astype("<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_id", "_toxic", "lang")] + [pa.array(words, pa.binary())], ["_id", "_toxic", "lang", "words"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(hash_all, f"_id {kind}, _toxic int, lang string, words binary")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_toxic``: all rows with a label that are not held out."""
    return docs.join(marked_ids(labels), F.col("doc_id") == F.col("_id")).drop("_id")


def score_counts(scored: DataFrame, labels: DataFrame, least: int = 20) -> list:
    """(lang, bin, clean, toxic, low, high) of all labelled rows of (doc_id, lang, score) that are not held out, by bins of the score.

    A bin is 1 / ``BINS`` of a unit of log odds, ``low`` and ``high`` are the
    scores at its ends. Languages with fewer than ``least`` rows of either
    class are counted under null, so the table is as long as the languages have bins.
    """
    odds = F.coalesce(F.ln("score") - F.ln(1 - F.col("score")), F.when(F.col("score") > 0.5, 40.0).otherwise(-40.0))
    counted = labelled_rows(scored, labels).groupBy("lang", F.round(odds * BINS).cast("int").alias("bin")).agg(
        F.count_if(F.col("_toxic") == 0).alias("clean"), F.count_if(F.col("_toxic") == 1).alias("toxic"),
        F.min("score").alias("low"), F.max("score").alias("high"))
    own = Window.partitionBy("lang")
    enough = F.least(F.sum("clean").over(own), F.sum("toxic").over(own)) >= least
    return (counted.withColumn("lang", F.when(enough, F.col("lang"))).groupBy("lang", "bin")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.min("low").alias("low"), F.max("high").alias("high")).collect())


def thresholds(counts: Sequence) -> dict:
    """Per language the score that separates best (fewest wrong, the middle of the widest best gap); None: all languages.

    Languages that ``score_counts`` left under null take the overall threshold.
    """
    def best(rows: Sequence) -> float:
        clean, toxic = np.zeros(80 * BINS + 1, np.int64), np.zeros(80 * BINS + 1, np.int64)
        low, high = np.full(80 * BINS + 1, 2.0), np.full(80 * BINS + 1, -1.0)
        for r in rows:
            at = r["bin"] + 40 * BINS
            clean[at] += r["clean"]
            toxic[at] += r["toxic"]
            low[at], high[at] = min(low[at], r["low"]), max(high[at], r["high"])
        if not clean.any() or not toxic.any():
            return 0.5
        used = high >= 0
        clean, toxic, low, high = clean[used], toxic[used], low[used], high[used]
        wrong = np.append(0, np.cumsum(toxic)) + (clean.sum() - np.append(0, np.cumsum(clean)))
        cuts = np.concatenate([[0.0], (low[1:] + high[:-1]) / 2, [1.0]])
        gaps = np.concatenate([[0.0], low[1:] - high[:-1], [0.0]])
        least_wrong = np.flatnonzero(wrong == wrong.min())
        return float(cuts[least_wrong[gaps[least_wrong].argmax()]])

    langs = {r["lang"] for r in counts if r["lang"] is not None}
    return {None: best(counts)} | {lang: best([r for r in counts if r["lang"] == lang]) for lang in langs}


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """The network, fitted on the whole sample.

    The sample has another share of toxic rows than the labels where its bounds
    reach one class more than the other; the output bias is moved to the shares
    of all labelled rows that are not held out.
    """
    texts, marks, _ = training_sample(docs, labels, settings)
    net = fit(texts, marks, settings)
    fitted = np.bincount(marks, minlength=2)
    n = labelled_rows(docs.select("doc_id"), labels).agg(*[F.count_if(F.col("_toxic") == kind).alias(str(kind)) for kind in (0, 1)]).first()
    if min(*fitted, *n) == 0:
        return net
    return net._replace(out_bias=net.out_bias + float(np.log(n[1] / n[0]) - np.log(fitted[1] / fitted[0])))


def threshold_column(found: dict, lang: str = "lang") -> Column:
    column = F.lit(found[None])
    for name, value in found.items():
        if name is not None:
            column = F.when(F.col(lang) == name, value).otherwise(column)
    return column


def score(docs: DataFrame, net: Network, rows: int = Settings().rows, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, one row per input row; null and empty texts are scored as texts without words.

    Ids may be null or repeated; an empty table gives an empty table.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(rows)
        for batch, texts in chunks(batches, "_text"):
            scores = [score_ids(net, hasher(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(scores, pa.float64())], [*keep, "score"])

    chosen = docs.select(*keep, F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema)
    return chosen.mapInArrow(compute, f"{fields}, score double")


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` columns, which include ``doc_id`` and ``lang``, with ``score`` and ``threshold``; every row is scored once."""
    net = train(docs, labels, settings)
    scored = cut(score(docs, net, settings.rows, keep))
    found = thresholds(score_counts(scored.select("doc_id", "lang", "score"), labels))
    return scored.withColumn("threshold", threshold_column(found))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) for every row of ``docs``.

    Null texts are scored as empty, null languages and those without enough
    labels by the threshold of all. Ids may be null or repeated, each row has
    its own score; extra columns are ignored; an empty table gives an empty one.
    """
    with_lang = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    return judge(with_lang, labels, settings).select(
        "doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
