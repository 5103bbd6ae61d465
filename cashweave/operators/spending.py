"""Reports over the stored ``spending_by_category``.

All but :func:`spending_detail` also accept ``category_totals``, which is cheaper to derive.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def _chosen(categories: DataFrame, months: Iterable[str] | None) -> DataFrame:
    return categories if months is None else categories.where(F.col("year_month").isin(list(months)))


def spending_kpis(categories: DataFrame, months: Iterable[str] | None = None) -> DataFrame:
    total = F.sum("total_spent")
    n_months = F.countDistinct("year_month")
    return _chosen(categories, months).agg(
        total.alias("total"),
        F.avg("total_spent").alias("avg_category"),
        n_months.alias("months"),
        F.countDistinct("category_item").alias("unique_items"),
        F.sum("transaction_count").alias("txns"),
        (total / F.greatest(n_months, F.lit(1))).alias("monthly_average"))


def _by(categories: DataFrame, months: Iterable[str] | None, *cols: str) -> DataFrame:
    return (_chosen(categories, months).groupBy(*cols)
            .agg(F.sum("total_spent").alias("total_spent")))


def spending_mix(categories: DataFrame, months: Iterable[str] | None = None) -> DataFrame:
    """Total per group and its share of everything chosen.

    The grand total is a scalar subquery over the group totals, so it reuses their exchange.
    """
    groups = _by(categories, months, "category_group")
    overall = groups.agg(F.sum("total_spent")).scalar()
    return (groups.withColumn("pct", F.col("total_spent") * 100 / F.nullif(overall, F.lit(0)))
            .orderBy(F.desc("total_spent"), "category_group"))


def top_categories(categories: DataFrame, months: Iterable[str] | None = None,
                   n: int = 15) -> DataFrame:
    return (_by(categories, months, "category_group", "category_item")
            .orderBy(F.desc("total_spent"), "category_group", "category_item").limit(n))


def spending_trend(categories: DataFrame, months: Iterable[str] | None = None) -> DataFrame:
    return (_by(categories, months, "year_month", "category_group")
            .orderBy("year_month", "category_group"))


def spending_detail(categories: DataFrame, months: Iterable[str] | None = None) -> DataFrame:
    return (_chosen(categories, months)
            .select("year_month", "category_group", "category_item", "transaction_count",
                    "total_spent", "pct_of_month")
            .orderBy(F.desc("year_month"), F.desc("total_spent")))
