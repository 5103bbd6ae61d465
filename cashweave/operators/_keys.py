"""Entity keys.

Every payroll, reconciliation, net-worth and forecast operator takes ``keys``: the columns that
name the household or person. ``keys=()`` treats the whole input as one household.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window


def left_join_per_day(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Left join on ``keys + day``, ``right`` holding at most one row per key and day.

    Without keys ``right`` has at most one row per calendar day, a bound that does not grow
    with the data, so it is broadcast and ``left`` is not shuffled at all. With keys it grows
    with the number of households: the strategy is left to Spark, which measures it.
    """
    if not keys:
        right = F.broadcast(right)
    return left.join(right, [*keys, day], "left")


def per_entity(keys: Sequence[str]):
    """Window over one entity. Only used on rows already reduced to one per day, step or group."""
    return Window.partitionBy(*keys)
