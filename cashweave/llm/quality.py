"""Quality rules: a table of thresholds compiled into one projection over measures of a text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import WORD, words

WINDOW = 8  # words

# Frequent short words of the four languages of the corpus.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "was", "for", "it", "on", "with", "as", "be", "at", "by",
    "this", "an", "are", "or", "le", "la", "les", "de", "et", "un", "une", "des", "est", "que", "qui", "dans",
    "en", "du", "pour", "der", "die", "das", "und", "ist", "nicht", "mit", "ein", "von", "zu", "den", "im",
    "el", "los", "y", "por", "para", "con", "del", "se", "las", "es", "a",
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``; a bound of None does not bind."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RESERVED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words",
            "mean_word_length", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio",
            "base_failed", "failed", "kept")

RULES = (
    Rule("words", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=2, high=15),
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.3),
)


def measures(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts and ratios that rules can name.

    Counts (long): ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``,
    ``n_stop_words`` and ``n_repeat_words`` (words in eight-word windows that stand twice or more in the text).
    Ratios (double): ``mean_word_length``, ``symbols_per_word``, ``stop_word_ratio``, ``dup_line_ratio`` and
    ``repeat_word_ratio``, all 0 for a text without words; NULL counts as such a text.

    Every step is a projection: no shuffle, no user function. Windows are compared by a 64-bit hash of their
    eight words; a text without a repeated hash stops there, for others the hashes are sorted with their places,
    so work is n log n for a text of n words however often it repeats itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop(*RESERVED)
    cut = docs.select(
        *docs.columns, words(text).alias("__w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("__lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    window = F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(
        *[F.get("__w", i + j) for j in range(WINDOW)]))
    counted = cut.select(
        *docs.columns, "n_symbols", F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.when(F.size("__w") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("__h"))
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    kept = [c for c in counted.columns if c != "__h"]
    ordered = counted.select(*kept, F.when(F.size("__h") > F.size(F.array_distinct("__h")), placed).alias("__s"))
    again = F.filter("__s", lambda x, j: (x["h"] == F.get("__s", j - 1)["h"]) | (x["h"] == F.get("__s", j + 1)["h"]))
    # Windows in order of place; each adds the words that the one before did not cover.
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")),
        lambda acc: acc["n"])
    full = ordered.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    return full.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words")})


def failed_rules(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a row of :func:`measures` fails, in the order of the table."""
    def check(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < F.lit(r.low))
        if r.high is not None:
            bad = bad | (F.col(r.measure) > F.lit(r.high))
        return F.when(bad, F.lit(r.name))
    return F.array_compact(F.array(*[check(r) for r in rules]))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with all measures, ``base_failed``, ``failed`` (names of rules) and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 in 100 words lie in repeated windows. Such a text is not
    kept whatever the rules say; the others are kept if no rule fails. NULL, empty and wordless texts are
    base failures. Each row is judged alone, so repeated rows and ties get the same verdict, and an empty table
    stays empty. Further columns are carried through, but for those whose names (``RESERVED``)
    the results need: these are replaced.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # Always true, but not deterministic to the optimizer: it would else push a filter on the verdict below all
    # projections, with every measure written out in it again and again.
    here = F.monotonically_increasing_id() >= 0
    return (measures(docs, text_col).withColumn("base_failed", base).withColumn("failed", failed_rules(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0) & here))
