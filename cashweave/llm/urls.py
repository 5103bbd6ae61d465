"""URL verdicts by host and path rules, and by a weighted vocabulary of unwanted terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_CHARACTERS = frozenset(LOWER + "0123456789")  # a hit has none of these directly before or behind it


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and all paths that start with ``path``."""
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms. A strict one weighs as much as is needed for a rejection, a soft one weighs one, and each
    counts once; ``limit`` distinct soft terms are a rejection."""
    strict: tuple[str, ...]
    soft: tuple[str, ...]
    limit: int = 2


# The rules of the contract.
RULES = (
    Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False), Rule("net", "/fr/", False),
)
# End of fixed values.

TERMS = Vocabulary(
    strict=("adult", "casino", "casinos", "escort", "escorts", "hentai", "malware", "phishing", "porn", "porno", "spam",
            "viagra", "warez", "xxx"),
    soft=("ads", "adserver", "bet", "bets", "betting", "bonus", "cheap", "cialis", "clickbait", "crack", "deal", "deals",
          "dating", "discount", "farm", "free", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "payday", "pharmacy",
          "pill", "pills", "poker", "popup", "replica", "sex", "slots", "torrent", "torrents", "track", "tracker", "win",
          "winner"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, in lower case; empty for NULL or without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for NULL or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value`` of the longest rule that fits, or NULL: a chain of tests, meant for up to a few hundred rules."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


@lru_cache(4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(text: str, automaton: ahocorasick.Automaton) -> list[str]:
    """Every occurrence of a term in ``text`` that no letter or digit touches, in order of its end."""
    out = []
    for last, term in automaton.iter(text):
        first = last - len(term) + 1
        if not (first and text[first - 1] in WORD_CHARACTERS) and not (
                last + 1 < len(text) and text[last + 1] in WORD_CHARACTERS):
            out.append(term)
    return out


def hits_of(text: Column, vocabulary: Vocabulary) -> Column:
    """All hits of a text column, one pass of an Aho-Corasick automaton over each text, an Arrow batch at a time."""
    terms = vocabulary.strict + vocabulary.soft

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        if not terms:
            return pa.array([[]] * len(texts), pa.list_(pa.string()))
        automaton = _automaton(terms)
        return pa.array([hits(t or "", automaton) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, vocabulary: Vocabulary = TERMS, url_col: str = "url",
          keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of every row and ``host``, ``path``, ``rule``, ``verdict``, ``n_strict``, ``n_soft``, ``terms``.

    The longest rule that fits decides. Where none does, the vocabulary judges the whole URL in lower case (A-Z
    only): one strict term, or ``limit`` distinct soft ones, block it; anything else is allowed. A term counts only
    where no ASCII letter or digit stands directly before or behind it, so ``essex`` holds no ``sex``. ``n_strict`` and
    ``n_soft`` are distinct terms, ``terms`` lists them in code point order.

    A NULL URL, and one without ``://``, has an empty host and path and no rule; NULL and empty URLs hold no term and are
    allowed. Rows are judged each by itself, however long or often repeated; no rows give no rows, and further
    columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"),
                        F.array_sort(F.array_distinct(hits_of(lower_ascii(url), vocabulary))).alias("found"))
    host, path = F.col("host"), F.col("path")

    def among(terms: Sequence[str]) -> Column:
        return F.size(F.array_intersect("found", F.array(*map(F.lit, terms)).cast("array<string>"))).cast("long")

    weight = F.col("n_strict") * vocabulary.limit + F.col("n_soft")
    rows = rows.select(
        *keep, "host", "path", _by_rule(host, path, rules, lambda r: r.name).cast("string").alias("rule"),
        _by_rule(host, path, rules, lambda r: "allow" if r.allow else "block").alias("by_rule"),
        among(vocabulary.strict).alias("n_strict"), among(vocabulary.soft).alias("n_soft"),
        F.array_join("found", ",").alias("terms"))
    return rows.select(
        *keep, "host", "path", "rule",
        F.coalesce("by_rule", F.when(weight >= vocabulary.limit, "block").otherwise("allow")).alias("verdict"),
        "n_strict", "n_soft", "terms")
