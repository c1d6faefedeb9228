"""Quality rules as a short-circuit cascade of column expressions.

All figures of a text are built-in functions of its row. Rules read figures of
their own besides those that are reported; these are computed inside a CASE
that stops at the first rejection, so a rule costs nothing for rows that
another one has rejected. The order of the rules comes from a sample, by share
rejected for each second spent.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.llm.common import SPACE_PATTERN, WORD_PATTERN, whole_text

# fixed values
SYMBOLS = "#*$%&|<>"
# fixed values: frequent words of the four languages, of which prose has some
FREQUENT = ("the", "of", "and", "to", "in", "is", "that", "with", "de", "la", "le", "les", "et", "est", "des", "en", "que", "el", "los", "del", "y",
            "der", "die", "das", "und", "den", "ist", "von", "zu")
LEFT_OPEN = "(\\.\\.\\.|\u2026)[\\x20\\x09-\\x0D]*$"


class Rule(NamedTuple):
    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def repeated_words(word_list: Column) -> Column:
    """Words in windows of three that the text holds twice or more.

    Windows are hashed and sorted with their places; equal neighbours repeat,
    and consecutive repeated places overlap by what they are short of three.
    """
    def positions(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        places = F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    found = _let(word_list, lambda w: F.when(F.size(w) >= 3, _let(F.sort_array(positions(w)), lambda s: _let(repeated(s), covered))))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.regexp_replace(line, SPACE_PATTERN, "")) > 0)


def with_figures(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words [, _text, _words]); null texts have no words."""
    rows = docs.select("doc_id", whole_text().alias("_text"))
    text = F.col("_text")
    rows = rows.select(
        "doc_id", "_text", words(text).alias("_words"),
        F.length(F.regexp_replace(text, SPACE_PATTERN, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    return rows.select("doc_id", F.size("_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                       repeated_words(F.col("_words")).alias("n_repeat_words"), *(["_text", "_words"] if keep else []))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))


def frequent_words(word_list: Column) -> Column:
    return F.size(F.filter(word_list, lambda w: w.isin(*FREQUENT)))


def open_lines(text: Column) -> Column:
    """Lines that end in an ellipsis."""
    return F.size(F.filter(_lines(text), lambda line: F.regexp_like(line, F.lit(LEFT_OPEN))))


def distinct_windows(word_list: Column, size: int = 5) -> Column:
    """Different windows of ``size`` words, by hash."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(word_list) - size), lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(size)]))
    return F.when(F.size(word_list) >= size, F.size(F.array_distinct(hashes))).otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rejections, written in whole numbers. The last four compute figures that no column reports."""
    n, chars, text, word_list = F.col("n_words"), F.col("word_chars"), F.col("_text"), F.col("_words")
    return [
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (20 * F.col("n_dup_lines") > n)),
        Rule("few_letters", 10 * letters(text) < 6 * chars),
        Rule("no_prose", frequent_words(word_list) < 2),
        Rule("open_lines", _let(_lines(text), lambda x: 10 * open_lines(text) > 3 * F.size(x))),
        Rule("repeated_windows", 10 * distinct_windows(word_list) < 3 * (n - 4)),
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 1000, runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) by rejection per cost, on about ``sample_rows`` rows chosen by a hash of the id.

    Each rule runs alone on the sample, whose reported figures are at hand; its
    cost is the fastest of some runs less that of a run without a rule. The
    order changes what is computed, never a verdict.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)) + 1)
    sample = docs.select("doc_id", "text").filter(chosen).limit(2 * sample_rows)      # the bound, should ids repeat
    figures = with_figures(sample, keep=True).filter(~base_failed()).cache()

    def fastest(rejects: Column) -> tuple[int, float]:
        spent = []
        for _ in range(runs):
            begun = time.perf_counter()
            rejected = figures.agg(F.count(F.when(rejects, 1))).first()[0]
            spent.append(time.perf_counter() - begun)
        return rejected, min(spent)

    try:
        n = figures.count()
        _, empty = fastest(F.col("n_words") < 0)
        measured = []
        for rule in rules:
            rejected, spent = fastest(rule.rejects)
            measured.append((rule, rejected / max(n, 1), max(spent - empty, 1e-4)))
    finally:
        figures.unpersist()
    return sorted(measured, key=lambda m: (-m[1] / m[2], m[2], m[0].name))


def cascade(rules: Sequence[Rule]) -> Column:
    """The first rule in order that rejects the row, null for kept rows; later rules are not evaluated."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.rejects, rule.name) if verdict is None else verdict.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if verdict is None else verdict


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """(doc_id, figures, base_failed, kept), one row per input row.

    ``kept`` is false where the base rules or any other rule rejects; rows that
    the base rules reject see no other. Null and empty texts have no words and
    fail. Ids may be null or repeated; extra columns are ignored; an empty table
    gives an empty table. Only the counts and times of the sample come to the
    driver.
    """
    ordered = [rule for rule, _, _ in order_rules(docs, default_rules() if rules is None else rules, sample_rows)]
    judged = with_figures(docs, keep=True)
    kept = cascade([Rule("base", base_failed()), *ordered]).isNull()
    return judged.select("*", base_failed().alias("base_failed"), kept.alias("kept")).drop("_text", "_words")
