"""Groups of spelling variants: words one edit apart, found with bit-sliced position indexes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import stored

RUN = r"[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET = 4096  # words of one index; what is larger is split by narrower windows
WINDOW = ("m", "i", "j", "key")


def runs(text: Column) -> Column:
    """All maximal runs of letters in a whole text, A-Z in lower case; none for NULL."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), 0)


class PositionIndex:
    """Words of ``size`` or ``size + 1`` letters as bit sets: ``at[p][c]`` has bit w if word w has letter c at place p.

    A search reads the query letter by letter. ``zero`` is the set of words equal to it so far, and three
    one-error sets are words that needed a replaced letter, an extra letter (they are read one place on) or a missing
    one (one place back). A step works on all words at once with a few operations on whole bit sets.
    """

    def __init__(self, words: list[str], size: int):
        self.size = size
        self.at: list[dict[str, int]] = [{} for _ in range(size + 2)]
        self.short = self.long = 0
        for w, word in enumerate(words):
            bit = 1 << w
            for place, c in enumerate(word):
                letters = self.at[place]
                letters[c] = letters.get(c, 0) | bit
            if len(word) == size:
                self.short |= bit
            else:
                self.long |= bit

    def near(self, query: str, end: bool) -> int:
        """The words one edit away whose first difference lies inside the window, as a bit set. A difference
        behind the last letter of the shorter word belongs to the next window unless this one is the last (``end``)."""
        return self._of_short(query, end) if len(query) == self.size else self._of_long(query, end)

    def _of_short(self, query: str, end: bool) -> int:
        zero, replaced, extra = self.short | self.long, 0, 0
        for place, c in enumerate(query):
            here = self.at[place].get(c, 0)
            extra = (extra | zero) & self.at[place + 1].get(c, 0)
            replaced = replaced & here | zero & ~here
            zero &= here
            if not zero | replaced | extra:
                return 0
        return replaced & self.short | (extra | zero if end else extra & ~zero) & self.long

    def _of_long(self, query: str, end: bool) -> int:
        zero, missing = self.short, 0
        for place, c in enumerate(query[:-1]):
            missing = missing & self.at[place - 1].get(c, 0) | zero
            zero &= self.at[place].get(c, 0)
            if not zero | missing:
                return 0
        missing &= self.at[self.size - 1].get(query[-1], 0)
        return missing | zero if end else missing & ~zero


def _windows(words: DataFrame) -> DataFrame:
    """Every word as the shorter of a pair (m letters) and as the longer (m + 1), in both halves of the m letters."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).where("m > 0")
    half = F.expr("cast(m div 2 as int)")
    halves = F.array(F.struct(F.lit(0).alias("i"), half.alias("j")), F.struct(half.alias("i"), F.col("m").alias("j")))
    return _keyed(sized.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.i", "w.j"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the letters outside the window, in which both words of a pair must agree."""
    key = F.concat(F.expr("left(word, i)"), F.expr("right(word, m - j)"))
    return rows.where("i < j").select(*(c for c in ("word", "n", "m", "i", "j")), key.alias("key"))


def _buckets(words: DataFrame, bucket: int) -> DataFrame:
    """Window rows whose buckets hold at most ``bucket`` words, or whose window is one letter wide."""
    rows, done = _windows(words), None
    while True:
        heavy = stored(rows.where("j - i > 1").groupBy(*WINDOW).agg(F.count("*").alias("c")).where(F.col("c") > bucket)
                       .drop("c"), "heavy-windows")
        if heavy.isEmpty():
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(heavy, list(WINDOW), "left_anti")
        done = calm if done is None else done.unionByName(calm)
        half = F.expr("cast((i + j) div 2 as int)")
        halves = F.array(F.struct(F.col("i").alias("i"), half.alias("j")), F.struct(half.alias("i"), F.col("j").alias("j")))
        rows = stored(_keyed(rows.join(heavy, list(WINDOW), "left_semi").select(
            "word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.i", "w.j")), "windows")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window rows sorted by window, falling n and word to (word, near, form, form_n) per row that has a near word."""
    def of(window, members) -> Iterator[tuple]:
        m, i, j, _ = window
        if len(members) < 2:
            return
        cut = [word[i:len(word) - (m - j)] for word, _ in members]
        if all(len(c) > j - i for c in cut):  # a pair needs a word of m letters
            return
        index = PositionIndex(cut, j - i)
        for (word, _), c in zip(members, cut):
            found = index.near(c, j == m)
            if found:  # the lowest bit is the word of largest n
                form, n = members[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), form, n

    window, members = None, []
    for b in batches:
        rows = zip(zip(*(b.column(c).to_pylist() for c in WINDOW)),
                   zip(b.column("word").to_pylist(), b.column("n").to_pylist()))
        out = []
        for w, group in groupby(rows, key=lambda r: r[0]):
            if w != window:  # a window may go on in the next batch
                out += of(window, members) if members else ()
                window, members = w, []
            members += [r[1] for r in group]
        yield _batch(out)
    yield _batch(list(of(window, members)) if members else [])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [])
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                      ["word", "near", "form", "form_n"])


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``word``, ``near`` (how many words are one edit away), ``form`` and ``form_n`` (the near word of largest n, ties to
    the smallest word), in one or more rows per word: the near words of a word are dealt to windows.

    A pair one edit apart agrees in all letters before and behind the edit. Words of m letters meet those
    of m and m + 1 letters in windows ``[i, j)``: they share a bucket if they agree in the first i and the last m - j
    letters, and a pair counts in the window that holds its first difference, so in exactly one. Windows start as the two
    halves of a word; a bucket of more than ``bucket`` words is dealt anew by the halves of its window, down to one
    letter, where a bucket is bounded by the square of the alphabet whatever the vocabulary holds.
    """
    rows = _buckets(words, bucket).repartition(*WINDOW).sortWithinPartitions(*WINDOW, F.col("n").desc(), "word")
    return rows.mapInArrow(_search, "word string, near long, form string, form_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)`` links without cycles, by pointer jumping: rounds grow with the logarithm of
    the longest chain."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of a table of words and counts ``n``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of largest n, ties to the smallest in code point order, if that n is at least ``ratio`` (2 or more, so that counts
    grow along forms and no circle can arise) times its own; ``root`` follows forms to the last and is the word
    itself where there is none. Rows of one word are added up; a NULL n counts nothing; NULL and empty words, and words
    without a positive n, are left out. Words may be of any length; no words give no rows; further columns are not read.
    """
    words = stored(words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n > 0"), "words")
    none = F.lit(None)
    found = near_words(words, bucket).select("word", none.cast("long").alias("n"), "near", "form", "form_n").unionByName(
        words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("string").alias("form"),
                     none.cast("long").alias("form_n")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    judged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = stored(judged.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")),
                    "judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
