"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cashweave.functions import (account_bucket, date_parts, direction, flow_category,
                                 is_paycheck_deposit, is_transfer, merchant_clean, parse_money,
                                 signed_balance, transaction_key)
from cashweave.operators import (flows, forecast as fc, health, networth as nw, payroll as pay,
                                 payslips as ps, reconciliation as rec, spending as sp,
                                 transactions as tx)
from cashweave.plans import refresh
from cashweave.schemas import BALANCE, CSV_COLUMNS_NEW, CSV_COLUMNS_OLD, PAYROLL_LINES, TRANSACTIONS_RAW
from cashweave.session import configure, scratch_path
from cashweave.sources import registry, store, transactions_csv as tcsv, workbooks as wb

from . import derive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MONTHS = ["1996-01", "1996-02", "1997-05"]
ENTITY, EMPLOYEE, HOUSEHOLD = ["entity_id"], ["employee_id"], ["household_id"]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that engines with other decimal types compare by value."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


class Inputs:
    """The derived inputs of one query, built on use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    @property
    def raw(self) -> DataFrame:
        return derive.transactions_raw(self.spark, self.sf_dir)

    @property
    def txns(self) -> DataFrame:
        return tx.clean_silver(self.raw)

    @property
    def entity_txns(self) -> DataFrame:
        return tx.clean_silver(self.raw, keys=ENTITY)

    @property
    def lines(self) -> DataFrame:
        return derive.payroll_lines(self.spark, self.sf_dir)

    @property
    def totals(self) -> DataFrame:
        return pay.paycheck_totals(self.lines)

    @property
    def payments(self) -> DataFrame:
        return pay.payments(self.lines)

    @property
    def accounts(self) -> DataFrame:
        return derive.accounts(self.spark, self.sf_dir)

    @property
    def snapshots(self) -> DataFrame:
        return derive.snapshots(self.spark, self.sf_dir)

    @property
    def categories(self) -> DataFrame:
        return tx.spending_by_category(self.txns)

    @property
    def category_totals(self) -> DataFrame:
        return tx.category_totals(self.txns)

    @property
    def savings(self) -> DataFrame:
        return pay.savings_rate(self.totals, self.lines)

    @property
    def history(self) -> DataFrame:
        return nw.net_worth_history(self.accounts, self.snapshots)

    @property
    def grids(self) -> DataFrame:
        return derive.payslip_grids(self.spark, self.sf_dir)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


def query(name: str):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(Inputs(spark, sf_dir)))
        return build
    return register


# --- files to bronze -------------------------------------------------------------------------


def _csv_text(raw: DataFrame) -> DataFrame:
    """The transactions as the text columns of a budget CSV; some amounts as printed money."""
    amount = F.col("amount").cast("string")
    printed = (F.when(F.col("note").isNull() & (F.col("amount") < 0),
                      F.concat(F.lit("("), F.format_number(F.abs("amount"), 2), F.lit(")")))
               .when(F.col("note").isNull(), F.concat(F.lit("$"), F.format_number("amount", 2)))
               .otherwise(amount))
    return raw.select(F.col("category_group").alias("Group"), F.col("category_item").alias("Item"),
                      F.col("transaction_type").alias("Type"),
                      F.date_format("transaction_date", "MM/dd/yyyy").alias("Date"),
                      F.col("merchant").alias("Merchant"), F.col("account").alias("Account"),
                      printed.alias("Amount"), F.col("note").alias("Note"))


def _write_csvs(q: Inputs) -> str:
    """Both layouts, and a third folder of files in no known layout, below one path."""
    text, path = _csv_text(q.raw), q.scratch("budget-csv")
    old = text.where("Account IS NULL").select(*CSV_COLUMNS_OLD)
    new = text.where("Account IS NOT NULL").select(*CSV_COLUMNS_NEW[::-1])
    for name, df in (("old", old), ("new", new), ("other", text.select("Group", "Amount"))):
        (df.write.option("header", "true").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .csv(f"{path}/{name}"))
    return f"{path}/*"


@query("a1_transactions_csv")
def _(q):
    raw = tcsv.read_transactions_csv(q.spark, _write_csvs(q))
    return tcsv.clean_transactions(raw).drop("source_file", "ingest_ts")


@query("a2_csv_layouts")
def _(q):
    path = _write_csvs(q)
    layouts = tcsv.classify_csv_layout(q.spark, path).select(
        F.regexp_extract("file", r"[^/]+$", 0).alias("source_file"), "layout",
        F.array_join("header", ",").alias("header"))
    return (tcsv.read_transactions_csv(q.spark, path).join(layouts, "source_file")
            .groupBy("layout", "header").agg(F.count("*").alias("rows")))


def _text_with_errors(q: Inputs) -> DataFrame:
    """Text rows of which those typed ``adjustment`` lost their date or their amount."""
    bad = F.col("Type") == "adjustment"
    gone = F.col("Note").isNull()
    return (_csv_text(q.raw)
            .withColumn("Date", F.when(bad & gone, "13/45/1996").otherwise(F.col("Date")))
            .withColumn("Amount", F.when(bad & ~gone, "n/a").otherwise(F.col("Amount")))
            .withColumn("source_file", F.lit("budget.csv"))
            .withColumn("ingest_ts", F.current_timestamp()))


@query("a4_empty_source")
def _(q):
    """Only files of the old layout, and a second folder without any file: typed all the same."""
    path = q.scratch("budget-csv")
    _csv_text(q.raw).where("Account IS NULL").select(*CSV_COLUMNS_OLD).write.option("header", "true").option(
        "escape", '"').csv(f"{path}/old")
    q.raw.where("false").select("note").write.text(f"{path}/none")
    both = [tcsv.clean_transactions(tcsv.read_transactions_csv(q.spark, f"{path}/{d}")) for d in ("old", "none")]
    return both[0].unionByName(both[1]).drop("source_file", "ingest_ts")


@query("a5_provenance")
def _(q):
    """File names without folders, the time of the load, and a key that the files' folders name."""
    path, started = q.scratch("budget-csv"), F.current_timestamp()
    (_csv_text(q.raw).withColumn("budget_year", F.year(F.to_date("Date", "MM/dd/yyyy"))).write.partitionBy("budget_year")
     .option("header", "true").option("escape", '"').csv(path))
    raw = tcsv.read_transactions_csv(q.spark, path, ["budget_year"])
    named = F.col("source_file").rlike(r"^part-[^/]*[.]csv$") & (F.col("ingest_ts") <= started)
    return raw.groupBy("budget_year", named.alias("is_named_and_stamped")).agg(F.count("*").alias("rows"))


@query("a6_clean_transactions")
def _(q):
    return tcsv.clean_transactions(_text_with_errors(q)).drop("source_file", "ingest_ts")


@query("a6_rejected_transactions")
def _(q):
    return (tcsv.rejected_transactions(_text_with_errors(q)).groupBy("Type", "reason")
            .agg(F.count("*").alias("rows")))


@query("a7_payslip_grids")
def _(q):
    return (wb.decode_workbooks(derive.workbooks(q.spark, q.sf_dir))
            .select("source_file", F.posexplode("grid").alias("row_no", "cells"))
            .withColumn("cells", F.array_join("cells", "|")))


@query("a8_payslip_meta")
def _(q):
    return ps.payslip_meta(q.grids)


@query("a9_payslip_sections")
def _(q):
    return (ps.payslip_sections(q.grids)
            .select("source_file", "section", "start",
                    F.array_join("headers", "|").alias("headers"), F.inline("rows"))
            .withColumn("values", F.array_join("values", "|")))


@query("a10_payslip_totals")
def _(q):
    return (ps.payslip_totals(ps.payslip_sections(q.grids))
            .select("source_file", "check_number", "description", "amount", "ytd"))


@query("a11_payslip_lines")
def _(q):
    return (ps.payslip_lines(ps.payslip_sections(q.grids))
            .select("source_file", "section", "description", "amount", "ytd", "hours", "rate",
                    "dates", "account_name", "account_number",
                    F.size("raw_payload").alias("payload_fields")))


@query("a12_parse_money")
def _(q):
    text = _csv_text(q.raw).select("Amount").distinct()
    return text.select("Amount", parse_money("Amount").alias("parsed"))


@query("a13_payroll_bronze")
def _(q):
    return ps.payroll_lines(q.grids).drop("ingest_ts", "raw_payload", "row_no")


def _per_file(df: DataFrame) -> DataFrame:
    return (df.groupBy("source_file")
            .agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"),
                 F.count("account").alias("with_account")))


@query("a14_replace_by_file")
def _(q):
    """Two loads: everything, then again the files of the years from 1998, with other amounts."""
    path = q.scratch("transactions-raw")
    batch = q.raw.withColumn("ingest_ts", F.current_timestamp())
    store.replace_by_file(batch, path, TRANSACTIONS_RAW)
    again = (batch.where(F.col("source_file") >= "budget_1998.csv")
             .withColumn("amount", F.col("amount") * 2))
    store.replace_by_file(again, path, TRANSACTIONS_RAW)
    return _per_file(store.read_loads(q.spark, path, TRANSACTIONS_RAW))


@query("a14_replace_one_file")
def _(q):
    """One file sent again in a load of its own; its rows of the first load are left out when the table is read, and
    the loads say which of their files still count."""
    path = q.scratch("transactions-raw")
    batch = q.raw.withColumn("ingest_ts", F.current_timestamp())
    store.replace_by_file(batch, path, TRANSACTIONS_RAW)
    again = batch.where("source_file = 'budget_1996.csv' AND transaction_type <> 'fund'").withColumn("amount", -F.col("amount"))
    store.replace_by_file(again, path, TRANSACTIONS_RAW)
    loads = store.manifest(q.spark, path).groupBy("source_file").agg(
        F.count("*").alias("loads"), F.max(F.when(F.col("is_current"), F.col("rows"))).alias("current_rows"))
    return _per_file(store.read_loads(q.spark, path, TRANSACTIONS_RAW)).join(loads, "source_file")


@query("a15_schema_evolution")
def _(q):
    """The first load has no account column; files loaded later have it."""
    path = q.scratch("transactions-raw")
    batch = q.raw.withColumn("ingest_ts", F.current_timestamp())
    older = T.StructType([f for f in TRANSACTIONS_RAW.fields if f.name != "account"])
    store.replace_by_file(batch.where("source_file < 'budget_2000.csv'"), path, older)
    store.replace_by_file(batch.where("source_file >= 'budget_2000.csv'"), path, TRANSACTIONS_RAW)
    return _per_file(store.read_loads(q.spark, path, TRANSACTIONS_RAW))


@query("a16_full_refresh")
def _(q):
    """A derived table refreshed twice; readers see the newest version."""
    path = q.scratch("spending")
    store.write_full(q.categories.where("year < 1998"), path)
    store.write_full(q.categories, path, ["year_month"])
    return store.read_table(q.spark, path)


def _registry(q: Inputs) -> DataFrame:
    """The accounts that are already registered: the active ones."""
    return (q.accounts.where("is_active").drop("household_id")
            .withColumn("account_id", F.col("account_id").cast("string")))


def _refreshed(q: Inputs, buckets: int) -> DataFrame:
    """All stored layers of many households, each an employee here: per gold table and household, rows and a total."""
    tables = refresh.Tables(q.scratch("lake"), ("employee_id",), buckets)
    store.replace_by_file(q.raw.withColumnRenamed("entity_id", "employee_id").withColumn("ingest_ts", F.current_timestamp()),
                          tables.bronze("transactions_raw"), TRANSACTIONS_RAW, tables.keys)
    store.replace_by_file(q.lines.withColumn("ingest_ts", F.current_timestamp()), tables.bronze("payroll_lines"),
                          PAYROLL_LINES, tables.keys)
    refresh.refresh_silver(q.spark, tables)
    refresh.refresh_gold(q.spark, tables)
    total = {"monthly_cashflow": "total_amount", "spending_by_category": "total_spent", "paycheck_breakdown": "amount",
             "paycheck_reconciliation": "variance", "money_flow_edges": "amount", "savings_rate": "pretax_savings"}
    return reduce(DataFrame.unionByName, (
        frame.groupBy("employee_id").agg(F.count("*").alias("rows"), F.sum(total[name]).cast("decimal(20,2)").alias("total"))
        .select(F.lit(name).alias("gold"), "employee_id", "rows", "total")
        for name, frame in refresh.gold_tables(q.spark, tables).items()))


@query("a17_gold_refresh_keyed")
def _(q):
    return _refreshed(q, 0)


@query("a17_gold_refresh_bucketed")
def _(q):
    """Silver and gold bucketed by household."""
    return _refreshed(q, 4)


@query("a18_insert_missing")
def _(q):
    seeds = q.accounts.select(F.col("account_id").cast("string"), "name", "account_type",
                              "institution", "display_order")
    return (registry.seed_accounts(_registry(q), seeds)
            .select("account_id", "name", "account_type", "institution", "is_active",
                    "display_order"))


@query("a19_new_snapshots")
def _(q):
    """Account balances of customers, of which some are negative, as entered balances."""
    entered = (derive.table(q.spark, q.sf_dir, "customer")
               .select(F.col("c_custkey").cast("string").alias("account_id"),
                       F.lit("2024-02-01").cast("date").alias("snapshot_date"),
                       F.col("c_acctbal").cast(BALANCE).alias("balance"),
                       F.col("c_mktsegment").alias("note")))
    return (registry.new_snapshots(entered)
            .select("account_id", "snapshot_date", "balance", "note",
                    F.col("entered_at").isNotNull().alias("is_stamped")))


@query("a20_delete_by_key")
def _(q):
    ids = q.snapshots.where("entered_at IS NULL").select("snapshot_id")
    return (store.delete_by_key(q.snapshots, ids, ["snapshot_id"])
            .select("snapshot_id", "account_id", "snapshot_date", "balance"))


@query("a20_delete_from_stored")
def _(q):
    """Two deletions from a stored table, each a small file beside its rows."""
    path, schema = q.scratch("snapshots"), q.snapshots.schema
    store.append_rows(q.snapshots, path)
    for gone in ("entered_at IS NULL", "account_id % 13 = 0"):
        store.delete_rows(q.snapshots.where(gone).select("snapshot_id"), path, ["snapshot_id"])
    return (store.read_live(q.spark, path, schema, ["snapshot_id"])
            .select("snapshot_id", "account_id", "snapshot_date", "balance"))


@query("a21_new_accounts")
def _(q):
    requests = (derive.table(q.spark, q.sf_dir, "part")
                .select(F.concat("p_name", F.lit(" No. "), "p_size").alias("name"),
                        F.lit("cash").alias("account_type"), F.col("p_brand").alias("institution")))
    return (registry.new_accounts(_registry(q), requests)
            .select("account_id", "name", "account_type", "institution", "is_active"))


@query("a21_refused_accounts")
def _(q):
    odd = F.col("p_size") % 7
    requests = (derive.table(q.spark, q.sf_dir, "part")
                .select(F.when(odd == 1, "  ").otherwise(F.col("p_name")).alias("name"),
                        F.when(odd == 2, "boat").when(odd != 3, "cash").alias("account_type"),
                        F.col("p_brand").alias("institution")))
    return registry.refused_accounts(requests).select("name", "account_type", "institution", "reason")


@query("a22_scan")
def _(q):
    return store.scan(q.categories, "year = 1996",
                      [F.desc("total_spent"), "year_month", "category_group", "category_item"], 100)


# --- derived columns -------------------------------------------------------------------------


@query("b1_direction")
def _(q):
    return (q.raw.select(direction().alias("direction"), F.abs("amount").alias("amount_abs"))
            .groupBy("direction").agg(F.count("*").alias("rows"),
                                      F.sum("amount_abs").alias("amount_abs")))


@query("b2_b3_flow_category")
def _(q):
    return (q.raw.select("transaction_type", is_transfer().alias("is_transfer"),
                         flow_category().alias("flow_category"))
            .groupBy("transaction_type", "is_transfer", "flow_category")
            .agg(F.count("*").alias("rows")))


@query("b4_date_parts")
def _(q):
    return (q.raw.select("transaction_date").distinct()
            .select("transaction_date", *[c.alias(n) for n, c in date_parts().items()]))


@query("b5_merchant_clean")
def _(q):
    return (q.raw.select("merchant", merchant_clean().alias("merchant_clean"))
            .groupBy("merchant", "merchant_clean").agg(F.count("*").alias("rows")))


@query("b6_paycheck_deposit")
def _(q):
    return (q.raw.select("category_group", is_paycheck_deposit().alias("is_paycheck_deposit"))
            .groupBy("category_group", "is_paycheck_deposit").agg(F.count("*").alias("rows")))


@query("b7_transaction_key")
def _(q):
    return (q.raw.select(transaction_key().alias("transaction_key")).groupBy("transaction_key")
            .agg(F.count("*").alias("rows")))


@query("b8_clean_silver")
def _(q):
    return q.txns.drop("ingest_ts")


for _section in ("earnings", "employee_taxes", "pre_tax_deductions", "post_tax_deductions",
                 "employer_paid_benefits", "taxable_wages", "withholding"):
    query(f"b9_{_section}")(lambda q, s=_section: pay.section_table(q.lines, s))


@query("b10_payments")
def _(q):
    return q.payments


@query("b12_b13_account_bucket")
def _(q):
    return (nw.latest_balances(q.snapshots, q.accounts)
            .select("account_id", account_bucket("account_type").alias("bucket"),
                    signed_balance("account_type", "balance").alias("signed_balance")))


# --- transactions ----------------------------------------------------------------------------


@query("e1_monthly_cashflow")
def _(q):
    return tx.monthly_cashflow(q.txns)


@query("e1_monthly_cashflow_keyed")
def _(q):
    return tx.monthly_cashflow(q.entity_txns, ENTITY)


@query("e2_spending_by_category")
def _(q):
    return q.categories


@query("e2_spending_by_category_keyed")
def _(q):
    return tx.spending_by_category(q.entity_txns, ENTITY)


@query("e6_daily_paycheck_income")
def _(q):
    return rec.daily_paycheck_income(q.txns)


@query("e12_flow_summary")
def _(q):
    return tx.flow_summary(q.txns)


@query("e12_top_expense_categories")
def _(q):
    return tx.top_expense_categories(q.txns)


@query("e13_load_report")
def _(q):
    return health.load_report(q.raw)


@query("g3_newest_transactions")
def _(q):
    return health.newest_transactions(q.raw).drop("entity_id")


@query("g3_newest_payroll_lines")
def _(q):
    return (health.newest_payroll_lines(q.lines)
            .select("check_date", "section", "description", "check_number", "amount"))


@query("r7_spending_by_group")
def _(q):
    return tx.spending_by_group(q.txns)


@query("r7_spending_by_group_months")
def _(q):
    return tx.spending_by_group(q.txns, MONTHS)


@query("r20_search_transactions")
def _(q):
    return tx.search_transactions(q.txns, flow="Expenses only", merchant="SUPPLIER#1")


@query("r20_search_by_month_and_group")
def _(q):
    return tx.search_transactions(q.txns, months=MONTHS, groups=["PROMO", "Income"], flow="All")


@query("r21_search_totals")
def _(q):
    return tx.search_totals(q.txns)


@query("r22_category_groups")
def _(q):
    return tx.category_groups(q.txns)


@query("r22_transaction_months")
def _(q):
    return tx.transaction_months(q.txns)


@query("r24_paycheck_deposits")
def _(q):
    return tx.paycheck_deposits(q.txns)


@query("r25_spending_by_merchant")
def _(q):
    return tx.spending_by_merchant(q.txns)


# --- spending reports ------------------------------------------------------------------------


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in cols})


@query("r10_spending_kpis")
def _(q):
    return _rounded(sp.spending_kpis(q.category_totals), "avg_category", "monthly_average")


@query("r11_spending_mix")
def _(q):
    return _rounded(sp.spending_mix(q.category_totals), "pct")


@query("r12_top_categories")
def _(q):
    return sp.top_categories(q.category_totals)


@query("r12_top_categories_months")
def _(q):
    return sp.top_categories(q.category_totals, MONTHS, 25)


@query("r13_spending_trend")
def _(q):
    return sp.spending_trend(q.category_totals)


@query("r14_spending_detail")
def _(q):
    return sp.spending_detail(q.categories)


# --- payroll ---------------------------------------------------------------------------------


@query("e3_paycheck_totals")
def _(q):
    return q.totals


@query("t4_dedupe_checks")
def _(q):
    """Every fourth check came again in a second, newer file."""
    first = q.lines.withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp"))
    again = (first.where(F.col("check_number").cast("bigint") % 4 == 0)
             .withColumn("source_file", F.concat(F.lit("again_"), "source_file"))
             .withColumn("ingest_ts", F.lit("2024-01-02").cast("timestamp")))
    return pay.dedupe_checks(first.unionByName(again)).drop("ingest_ts", "row_no")


@query("e4_paycheck_breakdown")
def _(q):
    return pay.paycheck_breakdown(q.totals, q.lines)


@query("e4_paycheck_breakdown_keyed")
def _(q):
    return pay.paycheck_breakdown(q.totals, q.lines, EMPLOYEE)


@query("e5_deposits_per_check_date")
def _(q):
    return rec.deposits_per_check_date(q.payments)


@query("e9_savings_rate")
def _(q):
    return q.savings


@query("e9_savings_rate_keyed")
def _(q):
    return pay.savings_rate(q.totals, q.lines, keys=EMPLOYEE)


@query("r5_pay_totals")
def _(q):
    return pay.pay_totals(q.totals)


@query("r5_pay_totals_months")
def _(q):
    return pay.pay_totals(q.totals, MONTHS)


for _section in flows.DEDUCTION_SECTIONS:
    query(f"r6_deduction_breakdown_{_section}")(
        lambda q, s=_section: pay.deduction_breakdown(q.lines, s))


@query("r9_pay_summary")
def _(q):
    return _rounded(pay.pay_summary(q.totals), "effective_rate", "take_home_rate")


@query("r15_paycheck_kpis")
def _(q):
    return _rounded(pay.paycheck_kpis(q.savings), "avg_savings_rate", "avg_total_savings_rate")


@query("r16_paycheck_composition")
def _(q):
    return pay.paycheck_composition(pay.paycheck_breakdown(q.totals, q.lines))


@query("r17_savings_trend")
def _(q):
    return pay.savings_trend(q.savings)


@query("r17_savings_long")
def _(q):
    return pay.savings_long(q.savings)


@query("r18_paycheck_detail")
def _(q):
    return pay.paycheck_detail(q.totals)


@query("r6_deduction_breakdown_keyed")
def _(q):
    return pay.deduction_breakdown(q.lines, "employee_taxes", keys=EMPLOYEE)


@query("r9_pay_summary_keyed")
def _(q):
    return _rounded(pay.pay_summary(q.totals, keys=EMPLOYEE), "effective_rate", "take_home_rate")


@query("r15_paycheck_kpis_keyed")
def _(q):
    return _rounded(pay.paycheck_kpis(pay.savings_rate(q.totals, q.lines, keys=EMPLOYEE), EMPLOYEE),
                    "avg_savings_rate", "avg_total_savings_rate")


@query("r17_savings_trend_keyed")
def _(q):
    return pay.savings_trend(pay.savings_rate(q.totals, q.lines, keys=EMPLOYEE), EMPLOYEE)


@query("r17_savings_long_keyed")
def _(q):
    return pay.savings_long(pay.savings_rate(q.totals, q.lines, keys=EMPLOYEE), EMPLOYEE)


@query("r18_paycheck_detail_keyed")
def _(q):
    return pay.paycheck_detail(q.totals, EMPLOYEE)


# --- reconciliation and flows ----------------------------------------------------------------


@query("j3_sum_within_days")
def _(q):
    deposits = q.txns.where("is_paycheck_deposit")
    return (rec.sum_within_days(q.totals, deposits, "check_date", "transaction_date", "amount")
            .select("check_number", "check_date", "income_near"))


@query("j3_sum_within_days_keyed")
def _(q):
    deposits = q.entity_txns.where("is_paycheck_deposit").withColumnRenamed("entity_id", "employee_id")
    return (rec.sum_within_days(q.totals, deposits, "check_date", "transaction_date", "amount", 30,
                                EMPLOYEE)
            .select("employee_id", "check_number", "check_date", "income_near"))


@query("e7_paycheck_reconciliation")
def _(q):
    return rec.reconcile(q.totals, q.payments, q.txns, carry=["check_number"])


@query("e7_paycheck_reconciliation_keyed")
def _(q):
    return rec.reconcile(q.totals, q.payments, q.entity_txns, keys=EMPLOYEE,
                         transaction_keys=ENTITY, carry=["check_number"])


@query("r19_reconciliation_kpis")
def _(q):
    return rec.reconciliation_kpis(rec.reconcile(q.totals, q.payments, q.entity_txns,
                                                 keys=EMPLOYEE, transaction_keys=ENTITY))


@query("r19_reconciliation_kpis_keyed")
def _(q):
    return rec.reconciliation_kpis(rec.reconcile(q.totals, q.payments, q.entity_txns, keys=EMPLOYEE,
                                                 transaction_keys=ENTITY), keys=EMPLOYEE)


@query("e8_money_flow_edges")
def _(q):
    return flows.money_flow_edges(q.totals, q.lines, q.txns)


@query("e8_money_flow_edges_keyed")
def _(q):
    return flows.money_flow_edges(q.totals, q.lines,
                                  q.entity_txns.withColumnRenamed("entity_id", "employee_id"),
                                  keys=EMPLOYEE)


@query("r4_money_flow")
def _(q):
    return flows.money_flow(q.totals, q.lines, q.txns)


@query("r4_money_flow_months")
def _(q):
    return flows.money_flow(q.totals, q.lines, q.txns, MONTHS, [1, 2])


@query("r3_available_months")
def _(q):
    return flows.available_months(q.txns, q.totals)


@query("r8_waterfall_summary")
def _(q):
    return flows.waterfall_steps(q.totals, q.lines, q.txns)


@query("r8_waterfall_detail")
def _(q):
    return flows.waterfall_steps(q.totals, q.lines, q.txns, detail=True, include_spending=True)


@query("r1_table_counts")
def _(q):
    return health.table_counts(tx.monthly_cashflow(q.txns), q.categories, q.savings,
                               flows.money_flow_edges(q.totals, q.lines, q.txns))


# --- net worth and forecast ------------------------------------------------------------------


@query("j5_latest_balances")
def _(q):
    return nw.latest_balances(q.snapshots, q.accounts)


@query("j6_as_of_balances")
def _(q):
    return nw.as_of_balances(q.snapshots, q.accounts)


def _probes(q: Inputs) -> DataFrame:
    """Accounts and days around their snapshots; some days before the first, some accounts asked twice for a day."""
    near = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 11 - 5).cast("int"))
    return (derive.table(q.spark, q.sf_dir, "events")
            .select((F.col("user_id") % 10).alias("household_id"), F.col("user_id").alias("account_id"), near.alias("as_of_date")))


@query("j6_as_of_probes")
def _(q):
    return nw.balances_as_of(_probes(q).drop("household_id"), q.snapshots)


@query("j6_net_worth_as_of")
def _(q):
    return nw.net_worth_as_of(_probes(q).drop("account_id"), q.accounts, q.snapshots, HOUSEHOLD)


@query("e10_net_worth_summary")
def _(q):
    return nw.net_worth_headline(q.accounts, q.snapshots)


@query("e10_net_worth_summary_keyed")
def _(q):
    return nw.net_worth_summary(q.accounts, q.snapshots, HOUSEHOLD)


@query("e11_net_worth_history")
def _(q):
    return q.history


@query("e11_net_worth_history_keyed")
def _(q):
    return nw.net_worth_history(q.accounts, q.snapshots, HOUSEHOLD)


@query("r23_current_balances")
def _(q):
    return nw.current_balances(q.snapshots, q.accounts)


@query("r23_active_accounts")
def _(q):
    return nw.active_accounts(q.accounts)


@query("r23_current_balances_keyed")
def _(q):
    return nw.current_balances(q.snapshots, q.accounts, HOUSEHOLD)


@query("r23_active_accounts_keyed")
def _(q):
    return nw.active_accounts(q.accounts, HOUSEHOLD)


@query("r23_snapshot_log")
def _(q):
    return (nw.snapshot_log(q.snapshots, q.accounts)
            .withColumn("entered_at", F.unix_micros(F.col("entered_at").cast("timestamp"))))


@query("r23_snapshot_log_keyed")
def _(q):
    short = (F.col("account_id") / 10).cast("long")  # ids that several households have
    return (nw.snapshot_log(q.snapshots.withColumn("account_id", short), q.accounts.withColumn("account_id", short),
                            keys=["household_id"])
            .withColumn("entered_at", F.unix_micros(F.col("entered_at").cast("timestamp"))))


def _nine(df: DataFrame, *cols: str) -> DataFrame:
    """Nine significant digits: the last ones depend on the order of summation."""
    return df.withColumns({c: F.format_string("%.8e", c).cast("double") for c in cols})


def _forecast(df: DataFrame) -> DataFrame:
    return _nine(df, "predicted", "lower", "upper").withColumn("x", F.round("x", 6))


@query("k1_k5_fit_exponential")
def _(q):
    return _rounded(fc.fit(q.history), "last_y", "mean_x", "mean_y", "slope", "sigma")


@query("k6_k8_forecast_exponential")
def _(q):
    return _forecast(fc.forecast(q.history))


@query("k6_k8_forecast_linear")
def _(q):
    return _forecast(fc.forecast(q.history, model="linear", width=25))


@query("k6_k8_forecast_keyed")
def _(q):
    history = nw.net_worth_history(q.accounts, q.snapshots, HOUSEHOLD)
    return _forecast(fc.forecast(history, HOUSEHOLD))


@query("k9_forecast_summary")
def _(q):
    history = nw.net_worth_history(q.accounts, q.snapshots, HOUSEHOLD)
    return _nine(fc.forecast_summary(history, HOUSEHOLD), "projected", "low", "high", "growth",
                 "growth_pct")
