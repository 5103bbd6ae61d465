"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and there if an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links ``(a, b)`` with a > b. Large: every node sends its larger neighbours to the
    smallest node it knows; small: every node sends its smaller neighbours and itself there."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    known = both.join(least, "a")
    if large:
        moved = known.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = known.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links between comparable ids to ``node`` and ``component``, the smallest id reachable.

    Nodes without links to others are left out. NULL ends, loops, repeated and reversed links change nothing; no
    links give an empty table. Every round is written to the shared folder; only a count and a checksum reach the
    driver. Rounds grow with the logarithm of the longest path; a node's neighbours are never gathered: a minimum,
    combined before the shuffle, is joined back, and Spark splits the join where a node has very many.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a IS NOT NULL AND b IS NOT NULL AND a > b").distinct(), "links")
    mark = None
    while True:
        now = stored(_stars(_stars(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
