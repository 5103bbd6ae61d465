"""Numbers within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path, staged


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "at",
             keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``out``, the place of each row from one within its group; NULL is a group like any other.

    Rows are dealt to ranges of (group, order), cut where a sample says that ranges are even, so a group that holds a
    third of all rows, or all with one name, is spread over many ranges. The rows of a range are numbered by themselves,
    and a table of counts per group and range says how many of the group come before. Rows that are equal in
    all of these are told apart by where they stood. The ranges are written once (``keep``, by default to a
    folder of its own below the shared one), because counts and rows must agree on them.
    """
    keep = keep or (lambda rows, name: staged(rows, scratch_path(rows.sparkSession, name)))
    along = [*group, *order]
    ranged = keep(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*along, "__tie")
                  .withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__range").alias("__in"),
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__range").orderBy(*order, "__tie")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group), F.col("__range") == F.col("__in"))
    return (ranged.withColumn("__at", F.row_number().over(inside)).join(starts, same)
            .select(*df.columns, (F.col("__before") + F.col("__at")).alias(out)))
