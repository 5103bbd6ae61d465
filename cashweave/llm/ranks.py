"""Ranks and running totals within groups of any size, without one task per group.

A window over a whole group would sort it in one task. Here each group is cut into buckets along
its order; a small table of totals per (group, bucket) gives where every bucket begins, and the
window only runs inside a bucket. Where the order has no even buckets of its own, because many rows may
share a key, :func:`ranges` makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import stored

RANGE, TIE = "__range", "__tie"
_B, _BEFORE, _ALL, _HAS = "__bucket", "__before", "__all", "__has"


def shuffle_key(id_col: Column, seed: int) -> Column:
    """Thirty-two hex digits that order rows at random, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def ranges(df: DataFrame, along: Sequence[Column]) -> DataFrame:
    """``df`` with ``__range`` and ``__tie``: the rows cut along an order into ranges that a sample says are even.

    ``__tie`` tells rows apart that are equal in all of ``along``, so that those too are spread over ranges, however
    many there are. A smaller range never holds a later row of (``along``, ``__tie``). There are as many ranges as shuffle
    partitions. ``along`` should be narrow, as its sample passes through the driver. The ranges are written once, because
    all that is worked out from them must agree on them. An empty table gives an empty table.
    """
    rows = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*along, TIE)
    return stored(rows.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column],
            value: Column | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over the rows of its group that come earlier, and
    ``total``, the sum over the group. Without ``value`` every row counts as one: ``before`` is the
    rank from zero.

    ``bucket`` must agree with the order: a smaller bucket never holds a later row. Its number of
    values per group is the size of the table of totals, and a bucket is what one task sorts. NULL is a
    group like any other. An empty table gives an empty table.
    """
    value = F.lit(1) if value is None else value
    keys = [f"__g{i}" for i in range(2 * len(group))]
    parts = {}
    for i, c in enumerate(group):  # NULL as a value of its own, so that joins find it
        parts[keys[2 * i]] = F.col(c).isNull()
        parts[keys[2 * i + 1]] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.withColumns({**parts, _B: bucket, _HAS: value.cast("long")})
    sums = rows.groupBy(*keys, _B).agg(F.sum(_HAS).alias("__n"))
    along = Window.partitionBy(*keys).orderBy(_B)
    starts = sums.select(
        *keys, _B, (F.sum("__n").over(along) - F.col("__n")).alias(_BEFORE),
        F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(_ALL))
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(starts, [*keys, _B])
            .withColumn("__upto", F.sum(_HAS).over(inside))
            .select(*df.columns, (F.col(_BEFORE) + F.col("__upto") - F.col(_HAS)).alias(before),
                    F.col(_ALL).alias(total)))
