"""Quality rules as a cascade that stops at the first rule that rejects a text.

Everything is DataFrame code. Each rule's cost (seconds) and selectivity (share of texts that it rejects) are measured
on a sample; the rules then run in the order of most rejection per second. A rule is a branch of one CASE
expression, so that the statistics of later rules are not computed for a text that an earlier one rejects. The order
decides about time only: a text is kept if no rule rejects it, whatever comes first.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Rows that costs and selectivities are measured on, about; they steer the order of the rules only.
SAMPLE_ROWS = 2_000
SAMPLE_SEED = 7


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def n_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    return _let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}+", "")).cast("long")


def n_capitals(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long")


def n_lettered_words(text: Column) -> Column:
    """Words that hold a letter."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*")).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more, the first of them included.

    Windows are compared by 64-bit hashes. Only a text with equal windows has them sorted.
    """

    def of_words(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(found) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(WINDOW))))
        return F.when(F.size(found) < WINDOW, F.lit(0)).otherwise(_let(hashes, of_windows))

    def of_windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _let(placed, of_sorted)).otherwise(F.lit(0))

    def of_sorted(placed: Column) -> Column:
        def equals(window: Column, j: Column) -> Column:
            before, after = (F.get(placed, j + step).getField("h") for step in (-1, 1))
            return F.coalesce(window.h == before, F.lit(False)) | F.coalesce(window.h == after, F.lit(False))

        at = F.sort_array(F.transform(F.filter(placed, equals), lambda window: window.i))
        return _let(at, covered)

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    return _let(words(text), of_words).cast("long")


STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": n_lines,
    "n_letters": n_letters,
    "n_capitals": n_capitals,
    "n_lettered_words": n_lettered_words,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the statistics that `of` names, each of which it uses once, and says whether the text goes."""

    name: str
    of: tuple[str, ...]
    rejects: Callable[..., Column]


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda repeated, n: 100 * repeated > 20 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda chars, n: chars < 2 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda chars, n: chars > 15 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, n: 100 * symbols > 30 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda repeated, n: 100 * (repeated - 2) > 30 * n),  # two are free
    Rule("capitals", ("n_capitals", "n_letters"), lambda capitals, n: 100 * capitals > 40 * n),
    Rule("words_without_letters", ("n_lettered_words", "n_words"), lambda lettered, n: 100 * lettered < 50 * n),
)


@dataclass(frozen=True)
class Measured:
    """What a sample says about a rule."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _rejects(rule: Rule, text: Column, known: Mapping[str, Column]) -> Column:
    found = rule.rejects(*(known[name] if name in known else STATISTICS[name](text) for name in rule.of))
    return F.coalesce(found, F.lit(False))


def _sample(docs: DataFrame, rows: int, known: Sequence[str]) -> DataFrame:
    """About `rows` of the texts with their known statistics, written once and dealt out evenly."""
    total = docs.count()
    part = docs.select("text")
    part = part.sample(rows / total, SAMPLE_SEED) if total > rows else part
    return written(statistics(part.repartition(part.sparkSession.sparkContext.defaultParallelism), known), "rule-sample")


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, known: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of `docs` (text), best first.

    A cost is the shorter of two runs, less that of reading the text alone; statistics that `known` names cost nothing.
    Equal gains keep the order given.
    """
    sample = _sample(docs, rows, known)
    text, columns = _text(sample), {name: sample[name] for name in known}

    def run(count: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        total, found = sample.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
        return time.perf_counter() - began, total, found

    run(F.octet_length(text))
    floor = min(run(F.octet_length(text))[0] for _ in range(2))
    found = []
    for rule in rules:
        count = _rejects(rule, text, columns).cast("long")
        seconds, total, rejected = min(run(count) for _ in range(2))
        found.append(Measured(rule, max(seconds - floor, 0.0), rejected / total if total else math.nan))
    return sorted(found, key=lambda x: -x.gain if x.gain == x.gain else 0.0)


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, known: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with `rejected_by`: the first rule of the measured order that rejects a row's text, null if none does.

    Statistics named by `known` become columns that all rows get; the others are computed for the rows that come so far.
    A null text is an empty one, and both have no words, which the rule few_words rejects. Other columns of `docs` stay
    as they are; those named like an added one are replaced. Equal rows are judged alike; an empty table gives an empty
    one. Whole texts count, however long. Which of several rejecting rules is named hangs on the measured order; whether
    one is named does not.
    """
    order = [x.rule for x in measure(docs, rules, known, sample_rows)]
    docs = statistics(docs, known)
    columns = {name: docs[name] for name in known}
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(_rejects(rule, _text(docs), columns), F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)


def statistics(docs: DataFrame, names: Sequence[str] = BASE) -> DataFrame:
    """`docs` with a column for each named statistic of `text`; columns with these names are replaced."""
    return docs.withColumns({name: STATISTICS[name](_text(docs)) for name in names}) if names else docs


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept: one row for each row of `docs` (doc_id, text), as by `cascade`."""
    found = cascade(docs.select("doc_id", "text"), known=BASE)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return found.withColumn("base_failed", base_failed).select("doc_id", *BASE, "base_failed", kept.alias("kept"))
