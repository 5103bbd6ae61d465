"""Secrets in texts: fixed patterns, and character Markov models for strings without a pattern."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ranks import shuffle_key

# The patterns and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more; shorter runs match nowhere
KINDS = ("assign", "access", "hex", "markov")
# End of fixed values.

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
LETTER = re.compile(r"[A-Za-z]")  # what has none is a number
LONG = re.compile(r"[A-Za-z0-9+/_=-]{8,}")   # what the models judge
STATES = len(ALPHABET) + 1                   # and the start of a string
CACHED_TOKENS = 1 << 16                      # whose verdict is remembered within a batch
_CODE = np.zeros(256, np.uint8)
_CODE[list(ALPHABET)] = np.arange(1, STATES)

SPAN = "array<struct<kind:string,start:int,end:int>>"


def _path(token: str) -> np.ndarray:
    return np.concatenate([[0], _CODE[np.frombuffer(token.encode(), np.uint8)]])


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each step between two characters, random over ordinary, and the sum to reach."""
    ratio: np.ndarray
    threshold: float = 12.0

    def score(self, token: str) -> float:
        at = _path(token)
        return float(self.ratio[at[:-1], at[1:]].sum())

    def random(self, token: str) -> bool:
        return bool(LETTER.search(token)) and self.score(token) >= self.threshold


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern, in code points, sorted by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _clear(start: int, end: int, base: list[tuple[str, int, int]], i: int) -> Iterator[tuple[int, int]]:
    """The parts of a place that no base span from the i-th on covers."""
    while i < len(base) and base[i][1] < end:
        if start < base[i][1]:
            yield start, base[i][1]
        start, i = max(start, base[i][2]), i + 1
    if start < end:
        yield start, end


def all_spans(text: str, random: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    """The base spans, and ``markov`` spans for what they leave of long tokens, where a part is long and ``random``
    holds of it."""
    base = base_spans(text)
    more, i = [], 0
    for m in LONG.finditer(text):
        while i < len(base) and base[i][2] <= m.start():
            i += 1
        more += [("markov", s, e) for s, e in _clear(*m.span(), base, i) if LONG.fullmatch(text, s, e) and random(text[s:e])]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_strings(docs: DataFrame, sample: int = 2000, seed: int = 5, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Labelled samples ``(token, random)``: tokens of the ``sample`` documents (a documented bound) that come
    first under a seeded key, random where a base pattern covers them and ordinary elsewhere, and as many seeded
    random strings in base 64 and in hex."""
    spark = docs.sparkSession
    chosen = (docs.select(F.col(id_col).alias("__id")).distinct()
              .orderBy(shuffle_key(F.col("__id"), seed), "__id").limit(sample))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "__id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                rows += [{"token": m[0], "random": any(s < m.end() and m.start() < e for _, s, e in base)}
                         for m in TOKEN.finditer(text or "") if len(m[0]) >= 4]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("token", pa.string()), ("random", pa.bool_())]))

    made = spark.range(sample).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    strings = made.select(F.explode(F.array(
        F.substring("h", 1, 40), F.substring(F.base64(F.unhex("h")), 1, 32))).alias("token"), F.lit(True).alias("random"))
    return texts.mapInArrow(run, "token string, random boolean").unionByName(strings)


def train(samples: DataFrame, threshold: float = 12.0) -> Model:
    """Two first-order character models from labelled samples, smoothed by one, as one table of log ratios. Only
    counts per pair of characters and label are gathered, at most 2 x 68 x 68 rows whatever the samples' size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, STATES, STATES), np.int64)
        for b in batches:
            for token, label in zip(b.column("token").to_pylist(), b.column("random").to_pylist()):
                if token and label is not None and TOKEN.fullmatch(token):
                    at = _path(token)
                    np.add.at(n[int(label)], (at[:-1], at[1:]), 1)
        where = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in where), pa.array(n[where])],
                                         ["label", "a", "b", "n"])

    counts = np.ones((2, STATES, STATES))
    for r in samples.mapInArrow(run, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(
            F.sum("n").alias("n")).collect():
        counts[r["label"], r["a"], r["b"]] += r["n"]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Model(logs[1] - logs[0], threshold)


def spans_of(model: Model, text: Column) -> Column:
    """All spans of a text column: ``kind``, ``start`` and ``end`` (exclusive) in code points, by start and kind.

    Patterns (``assign``, ``access``, ``hex``) always stay; ``markov`` marks further tokens of 8 or more characters
    with a letter whose log-likelihood ratio reaches the model's threshold; of a token that touches a pattern, each
    part outside is a token. NULL and empty texts
    have none. Texts are scanned whole, each by itself, so repeated rows agree; no rows give no rows, and other
    columns are not touched.
    """
    @F.arrow_udf(SPAN)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        random = lru_cache(CACHED_TOKENS)(model.random)
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t or "", random)]
                         for t in texts.to_pylist()], kind)

    return find(text)


def cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with spans, sorted by start, replaced by ``mark``; overlapping ones are one."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans replaced by ``mark``; overlapping spans are one. NULL stays NULL. One pass over a text,
    however many spans it has."""
    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if not s else cut(t, [(x["start"], x["end"]) for x in s], mark)
                         for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    found = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(spans) == 0, text).otherwise(run(text, found))


def cleaned(model: Model, text: Column, mark: str = "[SECRET]") -> Column:
    """What :func:`redact` makes of the spans of :func:`spans_of`, in one function; NULL for a text without spans. Spans never
    leave the Python worker, and a task needs one worker instead of two."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        random = lru_cache(CACHED_TOKENS)(model.random)
        return pa.array([cut(t, [s[1:] for s in spans], mark) if t and (spans := all_spans(t, random)) else None
                         for t in texts.to_pylist()], pa.string())

    return run(text)
