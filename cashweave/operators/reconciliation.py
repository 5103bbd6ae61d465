"""Pay deposits against recorded income within a window of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import money as M, recon_status
from ..schemas import ROTH_ACCOUNT_TEXT
from ._keys import left_join_per_day, per_entity
from .payroll import is_roth


def split_deposits(payments: DataFrame, roth: str = ROTH_ACCOUNT_TEXT,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Each deposit as budgeted or Roth by its account name. A NULL name is neither."""
    hit, amount = is_roth("account_name", roth), F.col("deposit_amount")
    return payments.select(*keys, "check_date", F.when(~hit, amount).alias("budgeted_total"),
                           F.when(hit, amount).alias("roth_ira_amount"))


def deposits_per_check_date(payments: DataFrame, roth: str = ROTH_ACCOUNT_TEXT,
                            keys: Sequence[str] = ()) -> DataFrame:
    return (split_deposits(payments, roth, keys).groupBy(*keys, "check_date")
            .agg(F.sum("budgeted_total").alias("budgeted_total"),
                 F.sum("roth_ira_amount").alias("roth_ira_amount")))


def daily_paycheck_income(transactions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (transactions.where("is_paycheck_deposit").groupBy(*keys, "transaction_date")
            .agg(F.sum("amount").alias("income")))


def add_within_days(per_day: DataFrame, day: str, value: str, out: str, days: int,
                    keys: Sequence[str]) -> DataFrame:
    """Add the total of ``value`` from ``days`` before to ``days`` after each row's day.

    ``per_day`` holds one row per key and day, so an entity's window cannot outgrow the calendar.
    """
    near = per_entity(keys).orderBy(F.unix_date(day)).rangeBetween(-days, days)
    return per_day.withColumn(out, F.sum(value).over(near))


def seen_within(daily: DataFrame, day: str, days: int, out_day: str, value: str) -> DataFrame:
    """The same for a single entity, days not in ``daily`` included: repeat each day's row for
    every day it can be seen from, to be added up by ``out_day``. Needs no window over it all."""
    seen_from = F.sequence(F.date_sub(day, days), F.date_add(day, days))
    return daily.select(F.explode(seen_from).alias(out_day), value)


def sum_within_days(left: DataFrame, right: DataFrame, left_day: str, right_day: str, value: str,
                    days: int = 5, keys: Sequence[str] = (), out: str = "income_near") -> DataFrame:
    """``left`` with the total of ``right.value`` dated within ``days`` of ``left_day``.

    A right row near two left rows counts for both. NULL where nothing is near, or no date. Left
    rows are joined on equality of the day, without a range join and without repeating them.
    """
    if keys:
        dated = right.select(*keys, F.col(right_day).alias(left_day), F.col(value).alias("_value"))
        per_day = (dated.unionByName(left.select(*keys, left_day), allowMissingColumns=True)
                   .groupBy(*keys, left_day).agg(F.sum("_value").alias("_value")))
        near = add_within_days(per_day, left_day, "_value", out, days, keys).drop("_value")
    else:
        daily = right.groupBy(right_day).agg(F.sum(value).alias("_value"))
        near = (seen_within(daily, right_day, days, left_day, "_value")
                .groupBy(left_day).agg(F.sum("_value").alias(out)))
    return left_join_per_day(left, near, keys, left_day).select(*left.columns, out)


def reconcile(totals: DataFrame, payments: DataFrame, transactions: DataFrame, days: int = 5,
              roth: str = ROTH_ACCOUNT_TEXT, match: float = 1, minor: float = 50,
              keys: Sequence[str] = (), transaction_keys: Sequence[str] | None = None,
              missing_label: str = M.MISSING, carry: Sequence[str] = ()) -> DataFrame:
    """One row per check of ``totals``: deposits, income recorded near it, gap and status.

    Everything known about a date is first brought together per ``keys + check_date`` with
    map-side combine, then joined once to the checks; checks are neither repeated nor regrouped.
    ``transaction_keys`` names the key columns on the transactions where they differ, and
    ``carry`` lists columns of ``totals`` to keep (for instance the check number).
    """
    renamed = transactions
    for k, t in zip(keys, transaction_keys or keys):
        renamed = renamed.withColumn(k, F.col(t))

    def per_date(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys, "check_date").agg(
            *[F.sum(c).alias(c) for c in ("budgeted_total", "roth_ira_amount", "income")])

    deposits = split_deposits(payments, roth, keys)
    if keys:
        income = (renamed.where("is_paycheck_deposit")
                  .select(*keys, F.col("transaction_date").alias("check_date"),
                          F.col("amount").alias("income")))
        # The dates of the checks themselves, so that each finds a row with its window.
        dates = totals.select(*keys, "check_date")
        known = add_within_days(per_date(deposits.unionByName(income, True).unionByName(dates, True)),
                                "check_date", "income", "income_near_check", days, keys)
    else:
        near = seen_within(daily_paycheck_income(renamed), "transaction_date", days, "check_date",
                           "income")
        known = (per_date(deposits.unionByName(near, allowMissingColumns=True))
                 .withColumnRenamed("income", "income_near_check"))
    zero = F.lit(0)
    return (left_join_per_day(totals, known, keys, "check_date")
            .withColumn("budgeted_deposits", F.coalesce("budgeted_total", zero))
            .select(*dict.fromkeys([*keys, *carry, "check_date"]), "gross_pay", "net_pay",
                    "budgeted_deposits",
                    F.coalesce("roth_ira_amount", zero).alias("roth_ira_deposit"),
                    "pre_tax_deductions", "employee_taxes", "post_tax_deductions",
                    "income_near_check",
                    F.round(F.col("budgeted_deposits") - F.coalesce("income_near_check", zero), 2)
                    .alias("variance"),
                    recon_status("budgeted_deposits", "income_near_check", match, minor,
                                 missing_label).alias("status")))


def reconciliation_kpis(recon: DataFrame, missing_label: str = M.MISSING,
                        keys: Sequence[str] = ()) -> DataFrame:
    status = F.col("status")
    return recon.groupBy(*keys).agg(
        F.count("*").alias("total_checks"), F.count_if(status == M.MATCH).alias("clean_matches"),
        F.count_if(status.isin(M.INVESTIGATE, missing_label)).alias("need_attention"))
