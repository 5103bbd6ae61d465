"""Row counts and load reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def table_counts(cashflow: DataFrame, categories: DataFrame, savings: DataFrame,
                 edges: DataFrame) -> DataFrame:
    # The four metric names.
    named = {"Cashflow records": cashflow, "Spending categories tracked": categories,
             "Paychecks loaded": savings, "Sankey flow edges": edges}
    return reduce(DataFrame.union, [
        df.agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value")
        for n, df in named.items()])


def load_report(loaded: DataFrame) -> DataFrame:
    return (loaded.groupBy("source_file", "account").agg(F.count("*").alias("rows"))
            .orderBy("source_file", "account"))


def newest_transactions(loaded: DataFrame, n: int = 20) -> DataFrame:
    return loaded.orderBy(F.desc("transaction_date"), "source_file", "category_group",
                          "category_item", "merchant", "amount").limit(n)


def newest_payroll_lines(loaded: DataFrame, n: int = 40) -> DataFrame:
    return loaded.orderBy(F.desc("check_date"), "section", "description", "check_number").limit(n)
