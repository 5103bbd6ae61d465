"""Payslip lines to section tables, check totals, pay composition and savings rates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bucket_key, in_months, month_of
from ..schemas import (CHECK_KEYS, POSTTAX_SAVINGS, PRETAX_SAVINGS, ROTH_ACCOUNT_TEXT,
                       TOTALS_METRICS)
from ._keys import left_join_per_day

# Section -> (bucket prefix, bucket group) of the pay composition.
BUCKETS = {
    "employee_taxes": ("tax_", "Employee Taxes"),
    "pre_tax_deductions": ("pretax_", "Pre-Tax Deductions"),
    "post_tax_deductions": ("posttax_", "Post-Tax Deductions"),
    "payment_information": ("deposit_", "Net Deposits"),
    "employer_paid_benefits": ("employer_", "Employer Benefits"),
}
SAVINGS_BUCKETS = ("pretax_savings", "posttax_savings", "roth_ira_deposit",
                   "employer_contributions")


def _check(keys: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*keys, *CHECK_KEYS]))


def section_table(payroll_lines: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """The lines of one section; earnings also carry hours, rate and date range.

    On the stored table ``section`` is the partition column, so only that partition is read.
    """
    extra = ["hours", "rate", F.col("dates").alias("date_range")] if section == "earnings" else []
    return (payroll_lines.where(F.col("section") == section)
            .select(*_check(keys), "description", "amount", "ytd", *extra))


def payments(payroll_lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (payroll_lines.where(F.col("section") == "payment_information")
            .select(*_check(keys), F.col("description").alias("bank"), "account_name",
                    F.col("account_number").alias("account_number_masked"),
                    F.col("amount").alias("deposit_amount")))


def paycheck_totals(payroll_lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per check: six metrics and their year-to-date values, in one aggregation.

    A metric that repeats within a check counts once, by its first row in the file. Checks with
    a NULL in their key are kept. All buffers are fixed-width, so this stays a hash aggregate
    with map-side combine.
    """
    def first(metric: str, value: str) -> Column:
        # The row number is NULL on other metrics, and min_by leaves NULL orderings out.
        return F.min_by(value, F.when(F.col("description") == metric, F.col("row_no")))

    return (payroll_lines
            .where((F.col("section") == "totals") & F.col("description").isin(*TOTALS_METRICS))
            .groupBy(*_check(keys))
            .agg(*[first(m, "amount").alias(c) for m, c in TOTALS_METRICS.items()],
                 *[first(m, "ytd").alias(f"{c}_ytd") for m, c in TOTALS_METRICS.items()]))


def dedupe_checks(payroll_lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep each check's lines from the newest file only, where one check came in two files.

    Only checks found in several files take part in the join, normally very few.
    """
    check = list(dict.fromkeys([*keys, "employee_id", "check_date", "check_number"]))
    repeated = (payroll_lines.groupBy(*check, "source_file")
                .agg(F.max("ingest_ts").alias("ingest_ts"))
                .groupBy(*check)
                .agg(F.max(F.struct("ingest_ts", "source_file"))["source_file"].alias("newest"),
                     F.count("*").alias("files"))
                .where("files > 1"))
    same_check = [payroll_lines[c].eqNullSafe(repeated[c]) for c in check]
    older = ~payroll_lines["source_file"].eqNullSafe(repeated["newest"])
    return payroll_lines.join(repeated, [*same_check, older], "left_anti")


def paycheck_breakdown(totals: DataFrame, payroll_lines: DataFrame,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Long form of each check: its gross pay and every line, from one scan of the lines."""
    section = F.col("section")

    def by_section(part: int) -> Column:
        out = None
        for s, bucket in BUCKETS.items():
            out = (F.when(section == s, bucket[part]) if out is None
                   else out.when(section == s, bucket[part]))
        return out

    lines = (payroll_lines.where(section.isin(*BUCKETS))
             .select(*keys, "check_date",
                     bucket_key(by_section(0), "description").alias("bucket"),
                     F.col("description").alias("bucket_label"),
                     by_section(1).alias("bucket_group"), "amount"))
    gross = totals.select(*keys, "check_date", F.lit("gross_pay").alias("bucket"),
                          F.lit("Gross Pay").alias("bucket_label"),
                          F.lit("Gross").alias("bucket_group"),
                          F.col("gross_pay").alias("amount"))
    return gross.unionByName(lines)


def is_roth(account_name: Column | str, text: str = ROTH_ACCOUNT_TEXT) -> Column:
    name = F.col(account_name) if isinstance(account_name, str) else account_name
    return F.lower(name).contains(text)


def savings_rate(totals: DataFrame, payroll_lines: DataFrame,
                 pretax: Sequence[str] = PRETAX_SAVINGS,
                 posttax: Sequence[str] = POSTTAX_SAVINGS,
                 roth: str = ROTH_ACCOUNT_TEXT, keys: Sequence[str] = ()) -> DataFrame:
    """Per check, the share of gross pay saved, without and with employer money.

    All four kinds of saving come from one conditional aggregation per key and check date,
    joined once; with no keys that side has one row per calendar day.
    """
    section, text = F.col("section"), F.col("description")
    kind = (F.when((section == "pre_tax_deductions") & text.isin(*pretax), SAVINGS_BUCKETS[0])
            .when((section == "post_tax_deductions") & text.isin(*posttax), SAVINGS_BUCKETS[1])
            .when((section == "payment_information") & is_roth("account_name", roth),
                  SAVINGS_BUCKETS[2])
            .when(section == "employer_paid_benefits", SAVINGS_BUCKETS[3]))
    sections = ["pre_tax_deductions", "post_tax_deductions", "payment_information",
                "employer_paid_benefits"]
    saved = (payroll_lines.where(section.isin(sections))
             .withColumn("kind", kind).where("kind IS NOT NULL")
             .groupBy(*keys, "check_date")
             .agg(*[F.sum(F.when(F.col("kind") == b, F.col("amount"))).alias(b)
                    for b in SAVINGS_BUCKETS]))
    own = sum((F.coalesce(F.col(b), F.lit(0)) for b in SAVINGS_BUCKETS[:3]), F.lit(0))
    match = F.coalesce(F.col(SAVINGS_BUCKETS[3]), F.lit(0))

    def rate(part: Column) -> Column:
        return F.round(part * 100 / F.nullif(F.col("gross_pay"), F.lit(0)), 2)

    return (left_join_per_day(totals, saved, keys, "check_date")
            .select(*keys, "check_date", month_of("check_date").alias("year_month"),
                    "gross_pay", "net_pay",
                    *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in SAVINGS_BUCKETS],
                    rate(own).alias("savings_rate_pct"),
                    rate(own + match).alias("total_savings_rate_pct")))


# --- reports ---------------------------------------------------------------------------------


def pay_totals(totals: DataFrame, months: Iterable[str] | None = None,
               keys: Sequence[str] = ()) -> DataFrame:
    return (totals.where(in_months("check_date", months)).groupBy(*keys)
            .agg(F.sum("gross_pay").alias("gross"), F.sum("employee_taxes").alias("taxes"),
                 F.sum("pre_tax_deductions").alias("pretax"),
                 F.sum("post_tax_deductions").alias("posttax"), F.sum("net_pay").alias("net")))


def deduction_breakdown(payroll_lines: DataFrame, section: str,
                        months: Iterable[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    return (payroll_lines.where((F.col("section") == section) & in_months("check_date", months))
            .groupBy(*keys, "description").agg(F.sum("amount").alias("amount"))
            .orderBy(*keys, F.desc("amount"), "description"))


def pay_summary(totals: DataFrame, months: Iterable[str] | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    def part(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    gross = F.sum("gross_pay")
    deducted = part("employee_taxes") + part("pre_tax_deductions") + part("post_tax_deductions")

    def of_gross(c: Column) -> Column:
        return F.coalesce(c * 100 / F.nullif(gross, F.lit(0)), F.lit(0))

    return (totals.where(in_months("check_date", months)).groupBy(*keys)
            .agg(gross.alias("total_gross"), deducted.alias("total_deductions"),
                 F.sum("net_pay").alias("total_net"),
                 of_gross(deducted).alias("effective_rate"),
                 of_gross(F.sum("net_pay")).alias("take_home_rate"),
                 F.countDistinct("check_date").alias("paychecks")))


def paycheck_kpis(savings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The averages are unweighted means of the per-check rates."""
    return (savings.groupBy(*keys)
            .agg(F.count("*").alias("check_count"), F.sum("gross_pay").alias("total_gross"),
                 F.sum("net_pay").alias("total_net"),
                 F.avg("savings_rate_pct").alias("avg_savings_rate"),
                 F.avg("total_savings_rate_pct").alias("avg_total_savings_rate")))


def paycheck_composition(breakdown: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (breakdown.where(F.col("bucket_group") != "Employer Benefits")
            .groupBy(*keys, "check_date", "bucket_group").agg(F.sum("amount").alias("amount"))
            .orderBy(*keys, "check_date", "bucket_group"))


def savings_trend(savings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (savings.select(*keys, "check_date", "savings_rate_pct", "total_savings_rate_pct",
                           *SAVINGS_BUCKETS)
            .orderBy(*keys, "check_date"))


def savings_long(savings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return savings.select(*keys, "check_date", *SAVINGS_BUCKETS).unpivot(
        [*keys, "check_date"], list(SAVINGS_BUCKETS), "bucket", "amount")


def paycheck_detail(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (totals.select(*keys, "check_date", "hours_worked", "gross_pay", "employee_taxes",
                          "pre_tax_deductions", "post_tax_deductions", "net_pay",
                          "gross_pay_ytd", "net_pay_ytd")
            .orderBy(*keys, F.desc("check_date")))
