"""Personal data: fixed patterns, and more spans by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns. For further spans,
candidates are runs of letters, digits, ``_`` and ``-`` with a digit in them
that no base span touches. Labelers vote on each candidate: key shapes
(regular expressions), names of secrets just before it (gazetteer), and words
and signs around it (context, setting, shape). Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; its posteriors are the soft labels of
a logistic classifier over features of the span, which decides. Candidates it
takes become spans of kind ``secret``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut
from cartwheel.llm.common import chunks

# fixed values: the base patterns; look-behinds and possessive repeats keep them linear in the text and change no match
KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_-]{8,}")

# fixed values: the labelers' patterns and names
_KEY_SHAPES = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_NAMES = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth|ssn|iban|passport)\s*[=:]?\s*[\"']?$", re.IGNORECASE)
_CONTEXT = re.compile(r"password|passwd|token|secret|key|login|credential|account|ssn|iban|passport|bearer", re.IGNORECASE)
LABELERS = 5
# an upper bound, for the classifier alone: its rows are chosen by a hash; votes are counted over all candidates
SAMPLE_ROWS = 20_000


class Model(NamedTuple):
    reliability: np.ndarray     # (LABELERS, 2): chance of a vote for clean and for private spans
    prior: float
    weights: np.ndarray


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an @, from the last match's end on."""
    end = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            end = match.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit that touch no base span."""
    if not _DIGIT.search(text):
        return []
    found, at = [], 0
    taken = sorted((a, b) for a, b, _ in base)
    reach = list(itertools.accumulate((b for _, b in taken), max))      # the furthest end so far
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            at += 1
        if not (at and reach[at - 1] > m.start()) and _DIGIT.search(m[0]):
            found.append((m.start(), m.end()))
    return found


def votes(text: str, start: int, end: int) -> int:
    """The labelers' votes as bits."""
    run, before = text[start:end], text[max(0, start - 24):start]
    letters = sum(c.isalpha() for c in run)
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:]))
    marks = [
        _KEY_SHAPES.fullmatch(run) is not None,
        _NAMES.search(before) is not None,
        _CONTEXT.search(text[max(0, start - 60):start]) is not None,
        (before[-1:] in ("=", ":", '"', "'") and before != "") or text[end:end + 1] in ('"', "'"),
        flips >= 3 and letters >= 2,
    ]
    return sum(1 << i for i, m in enumerate(marks) if m)


def features(text: str, start: int, end: int) -> list[float]:
    """Of the span and its neighbours; a constant last."""
    run, before, after = text[start:end], text[start - 1:start] if start else "", text[end:end + 1]
    n = len(run)
    digits = sum(c.isdigit() for c in run)
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:]))
    return [min(n, 64) / 32, digits / n, sum(c.isupper() for c in run) / n, flips / n, len(set(run)) / min(n, 36),
            float(re.fullmatch(r"[0-9a-f]+", run) is not None), float(before == "="), float(before in ('"', "'") and before != ""),
            float(after in ('"', "'") and after != ""), float(before == " "), float("-" in run or "_" in run), 1.0]


N_FEATURES = len(features("a1", 0, 2))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base array<int>, spans array<int>, votes array<int>, features array<float>) for each whole text.

    ``base`` and ``spans`` are flat: start, end, kind of base spans; start, end of candidates.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            columns: list[list] = [[], [], [], []]
            for text in texts:
                base = base_spans(text)
                more = candidates(text, base)
                columns[0].append([x for span in base for x in span])
                columns[1].append([x for span in more for x in span])
                columns[2].append([votes(text, *span) for span in more])
                columns[3].append([x for span in more for x in features(text, *span)])
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]],
                                             ["doc_id", "base", "spans", "votes", "features"])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(look, f"doc_id {kind}, base array<int>, spans array<int>, votes array<int>, features array<float>")


def reliabilities(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """Expectation-maximisation for labelers that vote independently given the truth.

    It starts from the share of votes a pattern has. Returns each labeler's chance of a vote for clean and
    for private spans, the share of private spans, and each pattern's posterior.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], np.float64)
    cast = (patterns[:, None] >> np.arange(LABELERS)) & 1
    posterior = np.clip(cast.mean(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((weight * posterior).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        chance = []
        for side in (1 - posterior, posterior):
            chance.append(((weight * side) @ cast + 0.5) / ((weight * side).sum() + 1))
        table = np.clip(np.stack(chance, axis=1), 1e-4, 1 - 1e-4)
        log = np.stack([cast @ np.log(table[:, k]) + (1 - cast) @ np.log(1 - table[:, k]) for k in (0, 1)], axis=1) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return table, prior, dict(zip(patterns.tolist(), posterior.tolist()))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on soft labels."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(scanned: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a scan, None without candidates. At most 32 vote counts and ``sample_rows`` spans come to the driver."""
    each = scanned.select(F.explode("votes").alias("v"))
    counts = {r["v"]: r["n"] for r in each.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    table, prior, posterior = reliabilities(counts)
    spans = scanned.filter(F.size("votes") > 0).select("doc_id", "features", F.posexplode("votes").alias("at", "v"))
    spans = spans.select("v", F.slice("features", F.col("at") * N_FEATURES + 1, N_FEATURES).alias("x"), F.xxhash64("doc_id", "features", "at").alias("h"))
    sample = spans.orderBy("h", "x").limit(sample_rows).collect()
    x = np.array([r["x"] for r in sample], np.float64)
    y = np.array([posterior[r["v"]] for r in sample])
    return Model(table, prior, fit_logistic(x, y))


def chosen(model: Model | None, flat_spans: Sequence[int], flat_features: Sequence[float]) -> list[tuple[int, int, int]]:
    """The candidates that the classifier takes."""
    if model is None or not len(flat_spans):
        return []
    spans = np.array(flat_spans).reshape(-1, 2)
    take = np.array(flat_features, np.float64).reshape(-1, N_FEATURES) @ model.weights > 0
    return [(a, b, len(KINDS) - 1) for a, b in spans[take].tolist()]


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans), one row per input row.

    Null and empty texts have no spans. Ids may be null or repeated; extra columns are ignored; an empty table
    gives an empty table. Base spans never change; candidates are added where the classifier says so.
    """
    scanned = cut(scan(docs))
    model = fit(scanned, sample_rows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(KINDS) + 2)]
            for base, spans, x in zip(*[batch.column(c).to_pylist() for c in ("base", "spans", "features")]):
                own = list(zip(base[::3], base[1::3], base[2::3]))
                every = own + chosen(model, spans, x)
                for k in range(len(KINDS)):
                    columns[k].append(sum(s[2] == k for s in every))
                columns[-2].append(hashlib.sha256(joined(own).encode()).hexdigest())
                columns[-1].append(joined(every))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(settle, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; of spans that overlap, the union takes the first one's kind."""
    parts, at, last = [], 0, -1
    for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])):
        if a >= last:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = last = max(b, last)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; null texts stay null, other columns as they are."""
    model = fit(cut(scan(docs)), sample_rows)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks([batch], "text"):
                new = []
                for text, valid in zip(texts, part.column("text").is_valid().to_pylist()):
                    base = base_spans(text)
                    more = candidates(text, base)
                    spans = base + chosen(model, [x for s in more for x in s], [x for s in more for x in features(text, *s)])
                    new.append(masked(text, spans) if valid else None)
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(mask, docs.schema)
