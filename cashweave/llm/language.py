"""Language of texts and of their parts: character models per word, joined by a Viterbi pass."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15          # hashed character trigrams
CHARACTERS = 1 << 21       # of text labelled side by side, and the rest of its last text
CACHED_WORDS = 1 << 19     # rows of scores that a Python worker keeps from batch to batch
LONGEST_CACHED = 64        # letters of a word that is remembered

# Unicode ranges of scripts; letters elsewhere count as one further script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul_jamo", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("latin_more", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
# End of fixed values.

RESULT = "struct<lang:string,score:double,switches:int,spans:array<struct<lang:string,start:int,end:int>>>"


def script_of(word: str) -> int:
    c = ord(word[0])
    return next((i for i, (_, lo, hi) in enumerate(SCRIPTS) if lo <= c <= hi), len(SCRIPTS))


def trigrams(word: str) -> list[int]:
    w = f" {word.lower()} "
    return [zlib.crc32(w[i:i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


class _Seen(dict):
    """Row numbers by word; a new word gets the next row of the tables of scores and letters. Very long words get a row
    each time and are not remembered, so that the memory has a bound in characters too."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, 0
        self.scores = np.zeros((1024, len(model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def __missing__(self, word: str) -> int:
        row, self.rows = self.rows, self.rows + 1
        if len(word) <= LONGEST_CACHED:
            self[word] = row
        if row == len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[row] = n = sum(map(str.isalpha, word))
        if n:
            self.scores[row] = self.model.score(word)
        return row


_SEEN: dict[str, _Seen] = {}  # of the model at work, for as long as a Python worker lives


@dataclass
class Model:
    """Log-probabilities of trigram buckets per language, and which languages each script leaves."""
    languages: list[str]
    logs: np.ndarray     # buckets x languages
    allowed: np.ndarray  # scripts x languages
    penalty: float = 15.0
    key: str = ""

    def __post_init__(self):
        self.key = hashlib.sha256(repr(self.languages).encode() + self.logs.tobytes() + self.allowed.tobytes()).hexdigest()

    def score(self, word: str) -> np.ndarray:
        """The word's log-likelihood in every language; far below for those that do not use its script."""
        s = self.logs[trigrams(word)].sum(axis=0)
        return s if not self.allowed[(k := script_of(word))].any() else np.where(self.allowed[k], s, s - 1e6)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of letters, one row per word."""
        seen = _SEEN.get(self.key)
        if seen is None or seen.rows > CACHED_WORDS:
            _SEEN.clear()
            seen = _SEEN[self.key] = _Seen(self)
        rows = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        return seen.scores[rows], seen.letters[rows]


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word when a change of label costs ``penalty``, for many texts side by side.

    ``scores`` has a row per word, text after text. Texts are ordered by length, so that step t works on the first
    few of them only, and equal scores fall to the first label.
    """
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    total = np.zeros((len(starts), scores.shape[1]))
    live = [int(np.searchsorted(-lengths, -t)) for t in range(int(lengths[0]) if len(lengths) else 0)]
    came, stayed = np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    for t, m in enumerate(live):
        at, sums = starts[:m] + t, total[:m]
        best = sums.argmax(axis=1)
        moved = sums[np.arange(m), best][:, None] - penalty
        stay = sums >= moved
        came[at], stayed[at] = best, stay
        total[:m] = np.where(stay, sums, moved) + scores[at]
    now = np.zeros(len(starts), np.int64)
    done = 0
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        if m > done:  # texts whose last word this is
            now[done:m] = total[done:m].argmax(axis=1)
            done = m
        at = starts[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(stayed[at, now[:m]], now[:m], came[at])
    return label


def train(docs: DataFrame, per_language: int = 512, penalty: float = 15.0, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled rows: at most ``per_language`` documents of each language (a documented bound), the
    first under a hash of the id in each of so many cells. Counts per language and bucket, combined before
    the shuffle, are all that is gathered: 32,768 numbers a language. Rows without id, text or language are left out."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    chosen = (docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
              .groupBy(F.col(lang_col).alias("__lang"), F.pmod(key, F.lit(per_language)).alias("__cell"))
              .agg(F.min_by(F.col(id_col), key).alias("__id")).select("__lang", "__id"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), ["__id", "__lang"]).select(F.col("__lang").alias("lang"), "text")
    width = BUCKETS + len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                n = counts.setdefault(lang, np.zeros(width, np.int64))
                for w in WORD.findall(text or ""):
                    if any(map(str.isalpha, w)):
                        np.add.at(n, [*trigrams(w), BUCKETS + script_of(w)], 1)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             ["lang", "at", "n"])

    found = rows.mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((width, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[found["at"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    seen, used = counts[:BUCKETS] + 0.1, counts[BUCKETS:]
    share = used / np.maximum(used.sum(axis=0, keepdims=True), 1)
    return Model(languages, np.log(seen / seen.sum(axis=0, keepdims=True)), share >= 0.01, penalty)


def _places(text: str, words: list[str], first: list[int]) -> list[tuple[int, int]]:
    """Where stretches of words stand in their text; ``first`` are the numbers of the words that begin one. Words are
    maximal, so each is found where a search from the one before it stops."""
    starts, ends, at = [], [], 0
    if len(first) == 1:
        return [(text.find(words[0]), text.rfind(words[-1]) + len(words[-1]))]
    begins = set(first)
    for i, w in enumerate(words):
        start = text.find(w, at)
        if i in begins:
            starts.append(start)
            ends.append(at)
        at = start + len(w)
    return list(zip(starts, [*ends[1:], at]))


def identify(model: Model, text: Column) -> Column:
    """Per text: ``lang``, ``score`` (the share of its letters in words labelled so), ``switches`` (changes of language
    along the text) and ``spans`` of one language in code points, from the first letter of a word to the last of another.

    The script of a word's first letter narrows the languages to those that use the script in training (all, if
    none does); each word is scored by its character trigrams, and the labelling with the best sum less a penalty per
    change wins. NULL texts and texts without letters are ``und`` with score 0, as is every text if nothing was
    learned. Ties go to the first language by name. Texts are read whole; a batch of texts is labelled side by side.
    """
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = model.languages

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        texts = [t or "" for t in texts.to_pylist()]
        out = [None] * len(texts)
        # Texts of like length side by side, and so many at a time that their words take little memory.
        order, group, held = sorted(range(len(texts)), key=lambda i: -len(texts[i])), [], 0
        for i in order:
            group.append(i)
            held += len(texts[i])
            if held > CHARACTERS:
                label_texts(texts, group, out)
                group, held = [], 0
        label_texts(texts, group, out)
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("switches", pa.int32()),
                                        ("spans", spans_type)]))

    def label_texts(texts: list[str], group: list[int], out: list) -> None:
        words = [WORD.findall(texts[i]) if names else [] for i in group]
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)[:-1]
        scores, letters = model.scores([w for ws in words for w in ws])
        label = viterbi(scores, starts, lengths, model.penalty) if len(scores) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(group)), lengths)
        k = max(1, len(names))
        by = np.bincount(doc * k + label, letters, len(group) * k).reshape(-1, k)
        changes = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (label[1:] != label[:-1])], minlength=len(group))
        total, best = by.sum(axis=1), by.argmax(axis=1)
        for g, i in enumerate(group):
            own, spans = label[starts[g]:starts[g] + lengths[g]], []
            if len(own):
                begin = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()] if changes[g] else [0]
                spans = [{"lang": names[own[f]], "start": s, "end": e}
                         for f, (s, e) in zip(begin, _places(texts[i], words[g], begin))]
            some = total[g] > 0
            out[i] = {"lang": names[best[g]] if some else "und", "score": by[g, best[g]] / total[g] if some else 0.0,
                      "switches": int(changes[g]), "spans": spans}

    return run(text)
