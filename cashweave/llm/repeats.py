"""Repeated byte strings across documents, by ranking ever longer strings and dropping what is unique.

Plain prefix doubling sorts every position of the corpus at every length. Here names of strings (hashes, equal for
equal strings) take the place of ranks, and four sorts of shrinking sets take the place of rounds over all positions:

1. Names of 24 bytes, built up by doubling, at sampled positions only: of any 77 successive positions that with the
   smallest name (leftmost, if equal) is an anchor, so equal 100-byte strings have the same anchor at the same place.
   The strings that share an anchor form a segment; Spark sorts segments by anchor name, and unique ones are dropped.
2. Within an anchor name segments are sorted by the name of the whole segment. All but the first of equal
   segments are settled: each of their strings starts earlier. The first ones go on if the anchor has several.
3. These are cut into parts of up to eight positions at fixed distances from the anchor, and treated likewise: parts
   are sorted by the name of the 93 bytes that all strings of a whole part would share, then by their own name.
4. What is left are parts that share the 93 bytes and no more: their single 100-byte strings are named and
   sorted, and all but the first of each name start earlier.

An anchor may stand in a third of all documents, at the edge of a common passage before ever other text. A task that
reads more than ``HOT`` names of one anchor deals the further ones by anchor and name, and round 2 passes their
first on to round 3 whether or not there are others: that costs a look more and misses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .components import stored

LENGTH = 100
CORE = 24                    # bytes of an anchor; short ones repeat by chance
SPAN = LENGTH - CORE + 1     # positions that one anchor must serve
BLOCK = 1 << 20              # bytes handled by one round of array operations, and the rest of the last text
LONGEST = 1 << 23            # bytes of one text handled at once; longer ones are cut with overlap
PART = 8                     # positions of a part of a segment
SEEN = 1 << 18               # segment names a task remembers, to settle copies before the shuffle
HOT = 64                     # names of an anchor that a task deals by the anchor alone

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def names(data: np.ndarray) -> np.ndarray:
    """A name of the 24 bytes from every position, by doubling: a name of 2k bytes comes from two of k, and the last
    from two of 16 that overlap."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    for k in (1, 2, 4, 8, 8):
        h = h[:-k] * _ODD[1] + (h[k:] ^ (h[k:] >> np.uint64(31))) * _ODD[2]
        h ^= h >> np.uint64(29)
    return h * _ODD[0]


def _anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every position whose 100 bytes lie in the data: of its 77 names the smallest, the leftmost if equal."""
    low = np.uint64(24)
    m = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = SPAN - width
    m = np.minimum(m[:-rest], m[rest:]) if rest else m
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64)


def _segments(data: bytes, owner: np.ndarray, offset: np.ndarray, ends: np.ndarray):
    """Of texts standing one after another in ``data``: text, start in the text, number of positions, anchor name
    and segment name of every segment. ``owner``, ``offset`` and ``ends`` are given per text."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < LENGTH:
        return None
    h = names(raw)
    anchor = _anchors(h)
    at = np.arange(len(anchor))
    text = np.searchsorted(ends, at, side="right")
    ok = at + LENGTH <= ends[text]
    at, text, anchor = at[ok], text[ok], anchor[ok]
    if not len(at):
        return None
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(new, len(at)))
    first = at[new]
    digest = xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(data[s:s + n + LENGTH - 1]) for s, n in zip(first.tolist(), count.tolist())),
                        np.uint64, len(first))
    begin = np.concatenate([[0], ends[:-1]])
    t = text[new]
    return (owner[t], offset[t] + first - begin[t], anchor[new] - first, count, h[anchor[new]].view(np.int64),
            whole.view(np.int64))


def _pack(start, ahead, count, hot, settled) -> np.ndarray:
    """A start, how far ahead the anchor is (7 bits), whether the anchor is hot, a number of positions (7) and
    whether they are settled in one long."""
    start, ahead, count, hot, settled = (np.asarray(x, np.int64) for x in (start, ahead, count, hot, settled))
    return start << 16 | ahead << 9 | hot << 8 | count << 1 | settled


def _start(packed: np.ndarray) -> np.ndarray:
    return packed >> 16


_HOT_BIT = np.int64(1 << 8)


def _count(packed: np.ndarray) -> np.ndarray:
    return packed >> 1 & 0x7F


class _Read:
    """What a task has read lately: the first place of every name, and how many names each anchor has."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.names: dict[int, int] = {}

    def deal(self, anchor: np.ndarray, name: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, ahead,
             count) -> pa.RecordBatch:
        """Rows to be dealt by their first column. Names read before at an earlier place (a smaller id, or earlier in
        the same row) are settled; they only pass through the next sort and are spread by place. Names of hot anchors are
        spread by anchor and name."""
        settled, hot = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        first, names = self.first, self.names
        places = zip(doc.tolist(), row.tolist(), start.tolist())
        for i, (key, place) in enumerate(zip(zip(anchor.tolist(), name.tolist()), places)):
            known = first.get(key)
            if known is None:
                names[key[0]] = names.get(key[0], 0) + 1
            elif known[0] < place[0] or known[:2] == place[:2] and known[2] < place[2]:
                settled[i] = True
                continue
            if known is None or place < known:
                first[key] = place
            hot[i] = names[key[0]] > HOT
        if len(first) > SEEN:
            first.clear()
            names.clear()
        odd = np.int64(0x5851F42D4C957F2D)
        dealt = np.where(settled, doc * 31 + (start >> 16) * odd, np.where(hot, anchor ^ (name * odd), anchor))
        return pa.RecordBatch.from_arrays(  # what settled rows hold compresses well: their names are not asked for again
            [pa.array(dealt), pa.array(np.where(settled, 0, name)), pa.array(doc), pa.array(row),
             pa.array(_pack(start, ahead, count, hot, settled))], COLUMNS)


COLUMNS = ["anchor", "name", "doc", "row", "packed"]
SEGMENT = ", ".join(f"{c} long" for c in COLUMNS)


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Read()

    def found(parts: list[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(p[0]) for p in parts])
        got = _segments(b"".join(p[0] for p in parts), np.arange(len(parts)), np.array([p[3] for p in parts]), ends)
        if got is None:
            return
        owner, start, ahead, count, anchor, name = got
        doc, row = (np.array([p[k] for p in parts], np.int64)[owner] for k in (1, 2))
        yield read.deal(anchor, name, doc, row, start, ahead, count)

    parts, held = [], 0
    for b in batches:
        for doc, row, data in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "data"))):
            for cut in range(0, max(1, len(data) - LENGTH + 1), LONGEST):
                parts.append((data[cut:cut + LONGEST + LENGTH - 1], doc, row, cut))
                held += len(parts[-1][0])
                if held >= BLOCK:
                    yield from found(parts)
                    parts, held = [], 0
    if parts:
        yield from found(parts)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments to settled ones (kind 0) and those to be taken apart (kind 1).

    Rows that share an id are not earlier than one another: one that repeats the first segment of its name in another
    row of the same id is taken apart like a first one.
    """
    last = None      # anchor, name and row of the segment last seen, and the id of the first one of its name
    waiting = None   # doc, row and packed of the only segment name so far of the last anchor
    for b in batches:
        anchor, name, doc, row, packed = (b.column(c).to_numpy() for c in COLUMNS)
        if not len(anchor):
            continue
        passed = (packed & 1).astype(bool)
        out = [(doc[passed], row[passed], packed[passed] >> 1 << 1, np.zeros(int(passed.sum()), np.int8))]
        anchor, name, doc, row, packed = (x[~passed] for x in (anchor, name, doc, row, packed))
        if len(anchor):
            hot = (packed & _HOT_BIT).astype(bool)
            packed = packed & ~_HOT_BIT
            before = (last[0], last[1]) if last else (~anchor[0], 0)
            other = np.concatenate([[anchor[0] != before[0]], anchor[1:] != anchor[:-1]])
            fresh = other | np.concatenate([[name[0] != before[1]], name[1:] != name[:-1]])
            group = np.cumsum(fresh) - 1  # -1: the name goes on from the batch before
            heads = np.flatnonzero(fresh)
            head_doc = np.append(doc[heads], last[2] if last else 0)[group]
            later = ~fresh & ((doc > head_doc) | (row == np.append(last[3] if last else 0, row[:-1])))
            out.append((doc[later], row[later], packed[later], np.zeros(int(later.sum()), np.int8)))
            beside = ~fresh & ~later
            out.append((doc[beside], row[beside], packed[beside], np.ones(int(beside.sum()), np.int8)))
            more = ~other[heads]  # a further name of its anchor
            apart = more | hot[heads]
            if len(heads) and more[0] and waiting is not None:
                out.append((*(np.array([w]) for w in waiting), np.ones(1, np.int8)))
            if len(heads):
                waiting = (doc[heads[-1]], row[heads[-1]], packed[heads[-1]]) if not apart[-1] else None
            apart[:-1] |= more[1:]
            pick = heads[apart]
            out.append((doc[pick], row[pick], packed[pick], np.ones(len(pick), np.int8)))
            last = (anchor[-1], name[-1], head_doc[-1], row[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc", "row", "packed", "kind"])


def _texts(batches: Iterator[pa.RecordBatch], named: Callable) -> Iterator[pa.RecordBatch]:
    """``named`` applied to every text and its packed places: rows of two names, a start and a number of positions."""
    read = _Read()
    for b in batches:
        for doc, row, data, packed in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "data", "places"))):
            rows = named(zstandard.decompress(data), np.array(packed, np.int64))
            a, n, start, count = np.array(rows, np.uint64).reshape(-1, 4).T.copy().view(np.int64)
            yield read.deal(a, n, np.full(len(a), doc, np.int64), np.full(len(a), row, np.int64), start, 0, count)


def _find_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest

    def parts(data: bytes, packed: np.ndarray) -> list[tuple[int, int, int, int]]:
        out = []
        for start, ahead, count in zip(_start(packed).tolist(), (packed >> 9 & 0x7F).tolist(), _count(packed).tolist()):
            anchor = start + ahead
            far, near = ahead, ahead - count + 1  # distances from the anchor of the first and the last position
            for part in range(near // PART, far // PART + 1):
                lo, hi = part * PART, min(part * PART + PART, SPAN) - 1
                first, last = anchor - min(hi, far), anchor - max(lo, near)
                out.append((digest(data[anchor - lo:anchor - hi + LENGTH]), digest(data[first:last + LENGTH]),
                            first, last - first + 1))
        return out

    return _texts(batches, parts)


def _find_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_intdigest

    def strings(data: bytes, packed: np.ndarray) -> list[tuple[int, int, int, int]]:
        return [((h := digest(data[p:p + LENGTH])) >> 64, h & 0xFFFFFFFFFFFFFFFF, p, 1)
                for start, count in zip(_start(packed).tolist(), _count(packed).tolist()) for p in range(start, start + count)]

    return _texts(batches, strings)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted single strings those that stand after the first of their name."""
    last = None
    for b in batches:
        a, n, doc, row, packed = (b.column(c).to_numpy() for c in COLUMNS)
        if not len(a):
            continue
        passed = (packed & 1).astype(bool)
        out = [(doc[passed], row[passed], packed[passed])]
        a, n, doc, row, packed = (x[~passed] for x in (a, n, doc, row, packed))
        if len(a):
            before = last or (~a[0], 0, 0, 0)
            fresh = np.concatenate([[(a[0], n[0]) != before[:2]], (a[1:] != a[:-1]) | (n[1:] != n[:-1])])
            group, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            head_doc = np.append(doc[heads], before[2])[group]
            later = ~fresh & ((doc > head_doc) | (row == np.append(before[3], row[:-1])))
            out.append((doc[later], row[later], packed[later]))
            last = (a[-1], n[-1], head_doc[-1], row[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc", "row", "packed"])


def _without(data: bytes, packed: list[int]) -> tuple[int, int, bytes]:
    """Bytes and runs covered by the strings at the packed places, and the bytes left."""
    p = np.array(packed, np.int64)
    start = _start(p)
    end = start + _count(p) - 1 + LENGTH
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    lo, hi = start[new], end[np.append(new[1:], len(end)) - 1]
    kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)]))
    return len(data) - len(kept), len(lo), kept


def _cut_out(data: Column, packed: Column) -> Column:
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    def run(data: pa.Array, packed: pa.Array) -> pa.Array:
        texts = map(zstandard.decompress, data.to_pylist())
        return pa.array([dict(zip(("n_removed", "n_spans", "kept"), _without(d, p) if p else (0, 0, d)))
                         for d, p in zip(texts, packed.to_pylist())], kind)

    return run(data, packed)


def _compressed(data: Column) -> Column:
    """A text is moved once more for each round that looks into it; compressed it takes half the disk."""
    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array(map(zstandard.ZstdCompressor(level=1).compress, data.to_pylist()), pa.binary())

    return run(data)


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows (``id``, ``data``) with ``doc``, the id (NULL before all), and ``row``: zero where no other row has the id, and
    else a number of the row's own, written out once so that it holds for all that follows."""
    keyed = rows.withColumn("doc", F.coalesce("id", F.lit(-(1 << 62))))
    shared = stored(keyed.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "shared-ids")
    alone = F.lit(0).cast("long").alias("row")
    if shared.isEmpty():
        return keyed.select("*", alone)
    numbered = stored(keyed.join(shared, "doc", "left_semi").select("*", (F.monotonically_increasing_id() + 1).alias("row")),
                      "numbered-rows")
    return keyed.join(shared, "doc", "left_anti").select("*", alone).unionByName(numbered)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary; NULL if all is kept).

    Removed is each byte covered by a 100-byte string that starts earlier too, in a document of smaller id (NULL before
    all) or earlier in the same one; strings overlap freely and are judged on the input. NULL and empty texts have no
    bytes; texts shorter than 100 bytes keep all. Rows that share an id (NULL as well) are documents of their own, none
    earlier than another. No rows give no rows; other columns are not read.

    Strings are compared by 128 bits of hash. Copies are settled before each shuffle where one task reads both,
    so a passage in a third of all documents is a few rows per task, and an anchor with very many names is spread by
    name. All texts are moved once, joined to the places found in them; later rounds move only those with any.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    keyed, text = _told_apart(rows), ["doc", "row"]

    def sorted_by_name(found: DataFrame, run: Callable, kind: str) -> DataFrame:
        return (found.repartition("anchor").sortWithinPartitions(*COLUMNS)
                .mapInArrow(run, f"doc long, row long, packed long{kind}"))

    def places(found: DataFrame, *names: str) -> DataFrame:
        return found.groupBy(*text).agg(*[
            F.collect_list(F.when(F.col("kind") == i, F.col("packed"))).alias(n) for i, n in enumerate(names)])

    found = sorted_by_name(keyed.select(*text, "data").mapInArrow(_find_segments, SEGMENT), _settle, ", kind byte")
    moved = keyed.select("id", *text, F.length("data").cast("long").alias("n_bytes"),
                         F.sha2("data", 256).alias("sha256"), _compressed(F.col("data")).alias("data"))
    marked = stored(moved.join(places(found, "settled", "apart"), text, "left").withColumn(
        "data", F.when(F.col("settled").isNotNull(), F.col("data"))), "repeat-texts")
    cut = marked.where("settled IS NOT NULL")
    apart = cut.where(F.size("apart") > 0).select(*text, "data", F.col("apart").alias("places"))
    parts = stored(places(sorted_by_name(apart.mapInArrow(_find_parts, SEGMENT), _settle, ", kind byte"),
                          "settled_parts", "single"), "repeat-parts")
    single = parts.where(F.size("single") > 0).select(*text, F.col("single").alias("places"))
    strings = cut.select(*text, "data").join(single, text).mapInArrow(_find_strings, SEGMENT)
    more = sorted_by_name(strings, _later, "").groupBy(*text).agg(F.collect_list("packed").alias("later"))
    none = F.array().cast("array<bigint>")
    done = (cut.join(parts.select(*text, "settled_parts"), text, "left").join(more, text, "left")
            .withColumn("r", _cut_out(F.col("data"), F.concat("settled", F.coalesce("settled_parts", none),
                                                              F.coalesce("later", none))))
            .select("id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept", F.sha2("r.kept", 256).alias("kept_sha256")))
    zero = F.lit(0).cast("long")
    rest = marked.where("settled IS NULL").select(
        "id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lit(None).cast("binary").alias("kept"),
        F.col("sha256").alias("kept_sha256"))
    return done.unionByName(rest).withColumnRenamed("id", id_col)
