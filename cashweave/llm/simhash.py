"""Near-duplicates by 64-bit SimHash, linked with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components, stored

BITS = 64
CHUNK = 1024       # members of a bucket that one group compares with as many others
PIVOTS = 16        # reference fingerprints
HASHES = 1 << 16   # shingle hashes unpacked to bits at once


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The majority bits of the XXH64 (seed 42) of all word shingles; zero without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    size = min(shingle, len(words))
    starts = [0] + [e + 1 for e in ends[:len(words) - size]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1:])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at:at + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a signed long; whole texts, an Arrow batch at a time."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        fps = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(fps.view(np.int64))

    return run(text.cast("binary"))


def _masks(distance: int, agree: int) -> list[int]:
    """Bit masks such that fingerprints at most ``distance`` bits apart agree on at least one of them: of
    ``distance + agree`` blocks of bits, at least ``agree`` hold no difference."""
    n = distance + agree
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def _pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The Hamming distance of every fingerprint to every reference fingerprint, one row per reference."""
    return np.bitwise_count(fps[None, :] ^ pivots[:, None]).astype(np.int8)


def _near(cells: np.ndarray, fps: np.ndarray, pivots: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one cell at most ``distance`` bits apart, contracted to stars.

    Rows are sorted by cell and distance to the first pivot, and compared with the row s places on for s = 1, 2, ...;
    a row is done when that coordinate differs by more than ``distance``. The other coordinates discard further
    pairs, since a difference above ``distance`` in any of them rules a pair out, and what survives is verified.
    """
    table = _pivot_table(fps, pivots)
    order = np.lexsort((table[0], cells))
    cells, fps, table = cells[order], fps[order], table[:, order]
    label = np.arange(len(fps))
    left = np.arange(len(fps))
    shift, pairs, held = 1, [], 0
    while True:
        left = left[left + shift < len(fps)]
        right = left + shift
        left = left[(cells[left] == cells[right]) & (table[0, right] - table[0, left] <= distance)]
        if not len(left):
            break
        a, b = left, left + shift
        for row in table[1:]:
            ok = np.abs(row[a] - row[b]) <= distance
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        pairs.append((a[ok], b[ok]))
        held += int(ok.sum())
        if held > 1 << 20:
            _contract(label, pairs)
            pairs, held = [], 0
        shift += 1
    _contract(label, pairs)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _contract(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Lower every row's label to the smallest row it reaches through ``pairs`` and its former label."""
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        apart = la != lb
        if not apart.any():
            return
        np.minimum.at(label, la[apart], low[apart])
        np.minimum.at(label, lb[apart], low[apart])
        while not np.array_equal(jump := label[label], label):
            label[:] = jump


def links(nodes: DataFrame, distance: int = 4, agree: int = 2, pivots: int = PIVOTS, seed: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect the same fingerprints as all pairs at most ``distance`` bits apart do.

    ``nodes`` holds each fingerprint once, in ``fp``. Pairs within reach agree on one of a few masks of bits (see
    :func:`_masks`), so fingerprints meet in buckets of equal masked bits; larger ``agree`` makes more and smaller
    buckets. Pivot distances alone would give no key to meet by: for unrelated fingerprints they differ by 4 or less
    in more than half of all cases, so a table needs many columns and all pairs. Inside the buckets the table
    does the discarding. A bucket of more than ``CHUNK`` members is compared chunk by chunk, each pair of chunks a
    group of its own, and every group returns the spanning stars of its links rather than its pairs.
    """
    reference = np.random.default_rng(seed).integers(0, 1 << 64, pivots, dtype=np.uint64)
    masks = _masks(distance, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = (keyed.join(shared, "bucket").withColumn("of", F.ceil(F.col("n") / CHUNK).cast("int"))
           .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(seed)), "of").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))))
    cells = met.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _near(c, f, reference, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            cell = np.concatenate([cell, b.column("cell").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            if len(cell) and cell[0] != cell[-1]:  # the last cell may go on in the next batch
                whole = int(np.searchsorted(cell, cell[-1]))
                yield found(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
        yield found(cell, fp)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def classes(marked: DataFrame, distance: int = 4, agree: int = 2, id_col: str = "doc_id",
            fp_col: str = "fp") -> DataFrame:
    """One row per distinct fingerprint: ``fp``, ``component_id`` (the smallest id of the component), and ``stays``, true
    for the one fingerprint of a component whose rows with that id stand for it."""
    nodes = stored(marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "nodes")
    linked = components(links(nodes, distance, agree))
    classed = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    first = classed.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first"))
    return classed.join(first, "component").select(
        "fp", F.col("first.least").alias("component_id"), (F.col("fp") == F.col("first.fp")).alias("stays"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, agree: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a fingerprint bit is set if over half of
    the hashes of all word shingles have it. Rows link at ``distance`` or fewer differing bits, and ``component_id``
    is the smallest id reachable. NULL, empty and wordless texts have fingerprint zero and link like any other; a text
    shorter than a shingle is one shingle. Repeated rows and ids stay rows of their own; a NULL id never is a component's
    id unless the component has no other, which is then NULL. Empty in, empty out; further columns are not read.

    Equal fingerprints are one node, so copies cost one row however many there are. Nothing of the graph reaches
    the driver, and fingerprints, links and every round of the components are written to the shared folder.
    """
    marked = stored(docs.select(id_col, fingerprint_of(F.col(text_col), shingle).alias("fp")), "fingerprints")
    return marked.join(classes(marked, distance, agree, id_col), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, agree: int = 2,
                            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`: the one with the smallest id (a NULL id only if
    there is no other; of rows that share that id and fingerprint, any one)."""
    marked = stored(docs.withColumn("__fp", fingerprint_of(F.col(text_col), shingle)), "marked")
    kept = (classes(marked, distance, agree, id_col, "__fp").where("stays")
            .select(F.col("fp").alias("__fp"), F.col("component_id").alias("__id")))
    rows = marked.join(kept, (marked["__fp"] == kept["__fp"]) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return rows.dropDuplicates(["__fp", id_col]).select(*docs.columns)
