"""Shards that each hold the whole table's mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranks import RANGE, TIE, ranges, running, shuffle_key

INTERVALS, ROWS = 4096, 1 << 16  # the intervals of the fractional ranks, or more, so that one holds about so many rows


def interleaved_shards(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id",
                       source_col: str = "source", tie: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Proportional stratified interleaving: the rows of a source are shuffled by a seeded key and
    ranked; rank r of n stands at (2r + 1) / 2n; all rows are sorted by that fraction and cut into
    runs whose lengths differ by one at most. Any run holds every source in proportion, to within one row.

    A source without rows in common with others, a NULL source and NULL ids are handled like any
    other; equal ids are ordered by ``tie`` and, if those agree as well, are interchangeable. A text may
    be NULL, empty or long: it is not read. An empty table gives an empty table. Input columns keep
    their names; ``shard`` and ``slot`` are reserved. Only the columns passed in are moved, three times, so
    pass narrow rows and join wide ones to the result.

    No task holds a source, or all rows of an id: ranks are worked out in sampled ranges of (source, shuffle key), and the
    sort by fraction, which spreads every source evenly, in equal intervals whose number grows with the rows.
    """
    source, ident = F.col(source_col), F.col(id_col)
    keyed = docs.withColumn("__key", shuffle_key(ident, seed))
    last = [F.col(c) for c in tie]
    dealt = ranges(keyed, [F.xxhash64(source), F.col("__key"), ident, *last])
    buckets = max(INTERVALS, dealt.count() // ROWS)
    ranked = running(dealt, [source_col], F.col(RANGE), [F.col("__key"), ident, *last, F.col(TIE)],
                     before="__rank", total="__of")
    placed = ranked.withColumn("__at", (2 * F.col("__rank") + 1) / (2 * F.col("__of")))
    lined = running(placed, [], F.floor(F.col("__at") * buckets),
                    [F.col("__at"), source.asc_nulls_last(), F.col("__rank")], before="__g", total="__all")
    shard = F.expr(f"__g * {shards} div __all")
    first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    return (lined.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("__g") - first)
            .drop(RANGE, TIE, "__key", "__rank", "__of", "__at", "__g", "__all"))
