"""Cleaning of budget transactions and the operators that need nothing else."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (date_parts, direction, flow_category, in_months, is_paycheck_deposit, rows_in_months,
                         is_transfer, merchant_clean, transaction_key)
from ..schemas import MERCHANT_CITY_SUFFIXES

FLOW_MODES = ("All", "Expenses only", "Income only", "Exclude transfers")


def clean_silver(raw: DataFrame, suffixes: Sequence[str] = MERCHANT_CITY_SUFFIXES,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Bronze transactions to the typed, classified table. One narrow projection, no shuffle."""
    def optional(name: str, dtype: str) -> Column:
        return (F.col(name) if name in raw.columns else F.lit(None).cast(dtype)).alias(name)

    return raw.select(
        *keys,
        transaction_key().alias("transaction_key"),
        "transaction_date",
        *[c.alias(n) for n, c in date_parts().items()],
        "category_group",
        "category_item",
        "transaction_type",
        flow_category().alias("flow_category"),
        direction().alias("direction"),
        is_transfer().alias("is_transfer"),
        is_paycheck_deposit().alias("is_paycheck_deposit"),
        F.col("merchant").alias("merchant_raw"),
        merchant_clean(suffixes=suffixes).alias("merchant_clean"),
        "amount",
        F.abs("amount").alias("amount_abs"),
        "note",
        "source_file",
        optional("ingest_ts", "timestamp"),
        optional("account", "string"),
    )


def is_expense() -> Column:
    return F.col("flow_category") == "expense"


def monthly_cashflow(transactions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per month and flow category, transfers left out; the category ``other`` stays in."""
    return (transactions.where(~F.col("is_transfer"))
            .groupBy(*keys, "year_month", "year", "month", "flow_category")
            .agg(F.count("*").alias("transaction_count"),
                 F.round(F.sum("amount_abs"), 2).alias("total_amount"),
                 F.round(F.avg("amount_abs"), 2).alias("avg_transaction"),
                 F.round(F.max("amount_abs"), 2).alias("max_transaction"),
                 F.countDistinct("category_item").alias("unique_categories")))


def category_totals(transactions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expenses per month, group and item: what every spending report adds up."""
    return (transactions.where(is_expense())
            .groupBy(*keys, "year_month", "year", "month", "category_group", "category_item")
            .agg(F.count("*").alias("transaction_count"),
                 F.round(F.sum("amount_abs"), 2).alias("total_spent"),
                 F.round(F.avg("amount_abs"), 2).alias("avg_transaction")))


def spending_by_category(transactions: DataFrame, keys: Sequence[str] = (), by_window: bool = False) -> DataFrame:
    """:func:`category_totals` with each one's share of the month's expenses.

    The month's total is added up from the category rows and joined back, rather than summed in
    a window, so that no task ever holds a whole month. Both sides of the join start from the
    same aggregate, down to the same columns, and Spark runs it once (a reused exchange). ``by_window`` is for rows that
    already lie together by ``keys``: a window holds the categories of one entity's month, and nothing is moved.
    """
    of_month = [*keys, "year_month"]
    per_category = category_totals(transactions, keys)
    if by_window:
        month = Window.partitionBy(*of_month)
        all_spent = F.sum("total_spent").over(month)
        return (per_category.withColumn("all_spent", all_spent)
                .withColumn("pct_of_month", F.when(F.col("all_spent") > 0, F.round(F.col("total_spent") * 100 / F.col("all_spent"), 2)))
                .drop("all_spent"))
    # Counts and means are carried along to keep the two aggregates alike.
    per_month = (per_category.groupBy(*[F.col(c).alias(f"_{c}") for c in of_month])
                 .agg(F.sum("total_spent").alias("all_spent"),
                      F.sum("transaction_count").alias("all_count"),
                      F.max("avg_transaction").alias("largest_mean")))
    if not keys:
        per_month = F.broadcast(per_month)  # one row per calendar month
    # Null-safe where there can be NULLs; equality keeps rows in place that already lie together by a key.
    same_month = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) if per_category.schema[c].nullable
                               else F.col(c) == F.col(f"_{c}") for c in of_month])
    has_total = (F.col("all_spent") > 0) & (F.col("all_count") > 0) & (F.col("largest_mean") >= 0)
    share = F.round(F.col("total_spent") * 100 / F.col("all_spent"), 2)
    return (per_category.join(per_month, same_month, "left")
            .select(*per_category.columns, F.when(has_total, share).alias("pct_of_month")))


def flow_summary(transactions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per month and flow category over all rows, transfers included."""
    return (transactions.groupBy(*keys, "year_month", "flow_category")
            .agg(F.count("*").alias("txn_count"),
                 F.round(F.sum("amount_abs"), 2).alias("total_abs")))


def top_expense_categories(transactions: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest expense categories of all time; ties resolved by name."""
    return (transactions.where(is_expense()).groupBy("category_group", "category_item")
            .agg(F.count("*").alias("txn_count"),
                 F.round(F.sum("amount_abs"), 2).alias("total_spent"))
            .orderBy(F.desc("total_spent"), "category_group", "category_item").limit(n))


def paycheck_deposits(transactions: DataFrame) -> DataFrame:
    return (transactions.where("is_paycheck_deposit")
            .select("transaction_date", "category_item", "merchant_clean", "amount")
            .orderBy("transaction_date"))


def spending_by_group(transactions: DataFrame, months: Iterable[str] | None = None,
                      keys: Sequence[str] = ()) -> DataFrame:
    return (transactions.where(is_expense() & rows_in_months(transactions, "transaction_date", months))
            .groupBy(*keys, "category_group").agg(F.sum("amount_abs").alias("amount"))
            .orderBy(F.desc("amount"), "category_group"))


def spending_by_merchant(transactions: DataFrame,
                         months: Iterable[str] | None = None) -> DataFrame:
    return (transactions.where(is_expense() & rows_in_months(transactions, "transaction_date", months))
            .groupBy("merchant_clean")
            .agg(F.count("*").alias("transaction_count"),
                 F.sum("amount_abs").alias("total_spent"))
            .orderBy(F.desc("total_spent"), "merchant_clean"))


def category_groups(transactions: DataFrame) -> DataFrame:
    return (transactions.select("category_group").where("category_group IS NOT NULL")
            .distinct().orderBy("category_group"))


def transaction_months(transactions: DataFrame) -> DataFrame:
    return transactions.select("year_month").distinct().orderBy(F.desc("year_month"))


def search_filter(months: Iterable[str] | None = None, groups: Iterable[str] | None = None,
                  flow: str = "Exclude transfers", merchant: str = "",
                  wildcards: bool = False) -> Column:
    """The conjunction of the given restrictions; an empty list restricts nothing.

    ``merchant`` is searched for as plain text, or as a LIKE pattern with ``wildcards``.
    """
    if flow not in FLOW_MODES:
        raise ValueError(f"flow must be one of {FLOW_MODES}")
    months, groups = list(months or ()), list(groups or ())
    hit = in_months("transaction_date", months) if months else F.lit(True)
    if groups:
        hit &= F.col("category_group").isin(groups)
    if flow == "Expenses only":
        hit &= is_expense()
    elif flow == "Income only":
        hit &= F.col("flow_category") == "income"
    elif flow == "Exclude transfers":
        hit &= ~F.col("is_transfer")
    if merchant:
        name = F.col("merchant_clean")
        hit &= (name.ilike(f"%{merchant}%") if wildcards
                else F.lower(name).contains(F.lower(F.lit(merchant))))
    return hit


def _hits(transactions: DataFrame, filters: dict) -> DataFrame:
    months = list(filters.get("months") or ()) or None
    return transactions.where(rows_in_months(transactions, "transaction_date", months) & search_filter(**filters))


def search_transactions(transactions: DataFrame, **filters) -> DataFrame:
    """The listing of :func:`search_filter` hits, newest and largest first."""
    return (_hits(transactions, filters)
            .select("transaction_date", "category_group", "category_item", "merchant_clean",
                    "amount", "amount_abs", "flow_category", "note")
            .orderBy(F.desc("transaction_date"), F.desc("amount_abs")))


def search_totals(transactions: DataFrame, **filters) -> DataFrame:
    def total(flow: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("flow_category") == flow, F.col("amount_abs"))),
                          F.lit(0))
    return (_hits(transactions, filters)
            .agg(F.count("*").alias("transactions"),
                 total("income").alias("total_inflow"),
                 total("expense").alias("total_outflow")))
