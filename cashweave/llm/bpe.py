"""Byte-level BPE: encoding by a queue of merge ranks over linked symbols, decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F

CACHED_PIECES = 5 << 17  # pieces of text whose ids a Python worker remembers, about 150 bytes each
LONGEST_CACHED = 64      # letters; longer pieces are worked out each time

# Fixed value: how a byte-level tokenizer cuts text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same for texts without a character outside these ranges, in classes that the standard library has; it takes
# half the time. Of the characters from U+00C0 to U+024F all but two are letters.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
WESTERN_PIECES = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+"
                  r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
NOT_WESTERN = re.compile(rf"[^\x00-\x7F{LETTERS}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the
    others, in order, for the characters from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class _Pieces(dict):
    """Packed ids by piece, worked out when first asked for; forgotten all at once when there are too many."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self._merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self._merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary file in the JSON format of byte-level BPE tokenizers."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and cutter["type"] == "ByteLevel" and spec["normalizer"] is None
                 and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")))
        if not plain:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.merges = {}  # rank and resulting id by pair of ids
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pairs = {bytes([a, b]): (m[0], x, y) for a, x in enumerate(self.first) for b, y in enumerate(self.first)
                      if (m := self.merges.get((x, y)))}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for string, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in string)
        for string, i in self.special.items():
            self.strings[i] = string.encode()
        self._any, self._western = regex.compile(PIECES).findall, re.compile(WESTERN_PIECES).findall
        longest = sorted(self.special, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._piece = _Pieces(self.merge).__getitem__

    def _cut(self, text: str) -> list[str]:
        return self._any(text) if NOT_WESTERN.search(text) else self._western(text)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. Symbols form a doubly linked list; the queue holds (rank, place, left, right), and an
        entry whose symbols have changed since is stale and skipped."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        merges, pairs, pop, push = self.merges, self.pairs, heapq.heappop, heapq.heappush
        queue = [(m[0], i, m[1], m[2]) for i in range(n - 1) if (m := pairs.get(piece[i:i + 2]))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = pop(queue)
            j = after[i]
            if ids[i] != left or j == n or ids[j] != right:
                continue
            new = ids[i] = merges[left, right][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    push(queue, (m[0], i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                push(queue, (m[0], h, ids[h], new))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if self._marks is None or not self._marks.search(text):
            return b"".join(map(self._piece, self._cut(text)))
        out = []
        for part in self._marks.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.extend(map(self._piece, self._cut(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}  # by digest, for as long as a Python worker lives


def codec_functions(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], ...]:
    """Three functions on columns, for the vocabulary at ``path``: ``encode`` (text to packed ids), ``decode`` (packed ids
    to text) and ``both`` (text to a struct of ``ids`` and ``decoded``, the text that these ids decode to).

    Ids are packed as little-endian unsigned 32-bit integers, so a row's count is its octets divided by four.
    The file is read on the driver and broadcast; its size is fixed. A NULL or empty text has no ids, and no ids
    decode to an empty text. Texts are encoded whole, each by itself, so ties and repeated rows agree; pieces of any
    length take n log n steps. Other columns are not touched, and no rows give no rows.
    """
    with open(path, "rb") as f:
        data = f.read()
    shared, key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def codec() -> Codec:
        if key not in _CODECS:
            _CODECS[key] = Codec(shared.value)
        return _CODECS[key]

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([c.encode(t or "") for t in texts.to_pylist()], pa.binary())

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([c.decode(b or b"") for b in ids.to_pylist()], pa.string())

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec()
        ids = [c.encode(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())],
                                          ["ids", "decoded"])

    return encode, decode, both
