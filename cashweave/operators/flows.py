"""Money-flow edges: gross pay to deductions, take-home to groups, groups to items."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import in_months, month_of, rows_in_months
from ._keys import per_entity
from .payroll import pay_totals
from .transactions import is_expense

# Node names and flow types of the edge list, labels of the steps.
GROSS, TAKE_HOME = "Gross Pay", "Take-Home"
PAYCHECK, SPENDING = "paycheck", "spending"
SHORT_STEPS = (("Taxes", "taxes"), ("Pre-Tax Ded.", "pretax"), ("Post-Tax Ded.", "posttax"))
REMAINING = "Remaining"
DEDUCTION_SECTIONS = ("employee_taxes", "pre_tax_deductions", "post_tax_deductions")


def _paycheck_edges(totals: DataFrame, payroll_lines: DataFrame, months, keys) -> list[DataFrame]:
    """Level 1. One description in two sections stays two edges, hence the section in the key."""
    inside = in_months("check_date", months)
    dates = [F.min("check_date").alias("first_date"), F.max("check_date").alias("last_date")]

    def shape(df: DataFrame, target: Column) -> DataFrame:
        return df.select(*keys, F.lit(GROSS).alias("source_node"), target.alias("target_node"),
                         "amount", F.lit(1).alias("level"), F.lit(PAYCHECK).alias("flow_type"),
                         "first_date", "last_date")

    deductions = (payroll_lines.where(F.col("section").isin(*DEDUCTION_SECTIONS) & inside)
                  .groupBy(*keys, "section", "description")
                  .agg(F.round(F.sum("amount"), 2).alias("amount"), *dates))
    take_home = (totals.where(inside).groupBy(*keys)
                 .agg(F.round(F.sum("net_pay"), 2).alias("amount"), *dates))
    return [shape(deductions, F.col("description")), shape(take_home, F.lit(TAKE_HOME))]


def _spending_edges(transactions: DataFrame, months, levels, keys) -> DataFrame:
    """Levels 2 and 3 from one aggregate per item: level 3 as it is, level 2 added up from the same exchange, whose
    rows are one per item by then."""
    items = (transactions.where(is_expense() & rows_in_months(transactions, "transaction_date", months))
             .groupBy(*keys, "category_group", "category_item")
             .agg(F.sum("amount_abs").alias("amount"),
                  F.min("transaction_date").alias("first_date"),
                  F.max("transaction_date").alias("last_date")))
    group, item = F.col("category_group"), F.col("category_item")

    def shape(df: DataFrame, source: Column, target: Column, level: int) -> DataFrame:
        return df.select(*keys, source.alias("source_node"), target.alias("target_node"),
                         F.round("amount", 2).alias("amount"), F.lit(level).alias("level"),
                         F.lit(SPENDING).alias("flow_type"), "first_date", "last_date")

    parts = []
    if 2 in levels:
        groups = items.groupBy(*keys, "category_group").agg(
            F.sum("amount").alias("amount"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
        parts.append(shape(groups, F.lit(TAKE_HOME), group, 2))
    if 3 in levels:
        parts.append(shape(items, group, item, 3))
    return reduce(DataFrame.unionByName, parts)


def money_flow_edges(totals: DataFrame, payroll_lines: DataFrame, transactions: DataFrame,
                     months: Iterable[str] | None = None, levels: Sequence[int] = (1, 2, 3),
                     keys: Sequence[str] = ()) -> DataFrame:
    """The edge list. Without keys the take-home edge exists even where there is no data."""
    if not levels or not set(levels) <= {1, 2, 3}:
        raise ValueError("levels must be a non-empty choice of 1, 2 and 3")
    months = None if months is None else list(months)
    parts = _paycheck_edges(totals, payroll_lines, months, keys) if 1 in levels else []
    if set(levels) & {2, 3}:
        parts.append(_spending_edges(transactions, months, levels, keys))
    return reduce(DataFrame.unionByName, parts)


def money_flow(totals: DataFrame, payroll_lines: DataFrame, transactions: DataFrame,
               months: Iterable[str] | None = None, levels: Sequence[int] = (1, 2, 3),
               keys: Sequence[str] = ()) -> DataFrame:
    """The edges of the chosen months and levels with a positive amount, largest first."""
    return (money_flow_edges(totals, payroll_lines, transactions, months, levels, keys)
            .where("amount > 0")
            .select(*keys, "source_node", "target_node", "amount", "level")
            .orderBy(*keys, "level", F.desc("amount")))


def available_months(transactions: DataFrame, totals: DataFrame) -> DataFrame:
    """Each side is made distinct before the union, so only months are moved."""
    return (transactions.select("year_month").distinct()
            .union(totals.select(month_of("check_date")).distinct())
            .distinct().where("year_month IS NOT NULL").orderBy(F.desc("year_month")))


def waterfall_steps(totals: DataFrame, payroll_lines: DataFrame, transactions: DataFrame,
                    months: Iterable[str] | None = None, detail: bool = False,
                    include_spending: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """From gross pay down to take-home, and on through spending: ordered steps with a balance.

    ``measure`` is ``absolute`` for gross pay, ``relative`` for what is subtracted and ``total``
    for the two balance lines. Everything that is ordered here is already one row per step.
    """
    months = None if months is None else list(months)
    pay = pay_totals(totals, months, keys).where("gross IS NOT NULL")

    def step(df: DataFrame, part: int, label: Column, amount: Column, measure: str) -> DataFrame:
        return df.select(*keys, F.lit(part).alias("part"), label.alias("label"),
                         amount.alias("amount"), F.lit(measure).alias("measure"))

    steps = [step(pay, 0, F.lit(GROSS), F.col("gross"), "absolute"),
             step(pay, 4, F.lit(TAKE_HOME), F.lit(0), "total")]
    if detail:
        section = F.col("section")
        lines = (payroll_lines
                 .where(section.isin(*DEDUCTION_SECTIONS) & in_months("check_date", months))
                 .groupBy(*keys, "section", "description").agg(F.sum("amount").alias("amount")))
        part = F.array_position(F.array(*[F.lit(s) for s in DEDUCTION_SECTIONS]), section)
        steps.append(lines.select(*keys, part.cast("int").alias("part"),
                                  F.col("description").alias("label"),
                                  (-F.col("amount")).alias("amount"),
                                  F.lit("relative").alias("measure")))
    else:
        zero = F.lit(0)
        for part, (label, c) in enumerate(SHORT_STEPS, start=1):
            steps.append(step(pay, part, F.lit(label), -F.coalesce(c, zero), "relative"))
    if include_spending:
        # One scan: each group brings the line of the rest along, which is then kept once.
        spent = (transactions.where(is_expense() & rows_in_months(transactions, "transaction_date", months))
                 .groupBy(*keys, F.col("category_group").alias("label")).agg((-F.sum("amount_abs")).alias("amount")))
        no_amount = F.lit(0).cast(spent.schema["amount"].dataType)
        lines = F.array(F.struct(F.lit(5).alias("part"), "label", "amount", F.lit("relative").alias("measure")),
                        F.struct(F.lit(6).alias("part"), F.lit(REMAINING).alias("label"), no_amount.alias("amount"),
                                 F.lit("total").alias("measure")))
        steps.append(spent.select(*keys, F.inline(lines)).distinct())

    order = per_entity(keys).orderBy("part", "amount", F.asc_nulls_first("label"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (reduce(DataFrame.unionByName, steps)
            .select(*keys, F.row_number().over(order).alias("step"), "label", "amount", "measure",
                    F.sum("amount").over(running).alias("balance"))
            .orderBy(*keys, "step"))
