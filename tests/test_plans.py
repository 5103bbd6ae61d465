"""The plans are what makes the operators scale, so they are tested like results."""

import re

import pytest
from pyspark.sql import functions as F

from cashweave.operators import (flows, forecast as fc, networth as nw, payroll as pay, payslips as ps,
                                 reconciliation as rec, transactions as tx)
from cashweave.session import scratch_path, staged
from cashweave.sources.numbering import numbered
from fixtures import derive
from .conftest import plan


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """The derived inputs as Parquet tables, so that scans are visible in the plans."""
    def store(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    txns = store(tx.clean_silver(derive.transactions_raw(spark, sf_dir), keys=["entity_id"]), "txns")
    lines = store(derive.payroll_lines(spark, sf_dir), "lines")
    return {"txns": txns, "lines": lines, "totals": store(pay.paycheck_totals(lines), "totals"),
            "accounts": store(derive.accounts(spark, sf_dir), "accounts"),
            "snapshots": store(derive.snapshots(spark, sf_dir), "snapshots"),
            "grids": store(derive.payslip_grids(spark, sf_dir), "grids")}


def every_operator(t):
    paid = pay.payments(t["lines"])
    history = nw.net_worth_history(t["accounts"], t["snapshots"])
    return {
        "cashflow": tx.monthly_cashflow(t["txns"]), "categories": tx.spending_by_category(t["txns"]),
        "categories_keyed": tx.spending_by_category(t["txns"], ["entity_id"]),
        "totals": pay.paycheck_totals(t["lines"]), "breakdown": pay.paycheck_breakdown(t["totals"], t["lines"]),
        "savings": pay.savings_rate(t["totals"], t["lines"]),
        "recon": rec.reconcile(t["totals"], paid, t["txns"]),
        "recon_keyed": rec.reconcile(t["totals"], paid, t["txns"], keys=["employee_id"], transaction_keys=["entity_id"]),
        "edges": flows.money_flow_edges(t["totals"], t["lines"], t["txns"]),
        "current": nw.latest_balances(t["snapshots"], t["accounts"]), "history": history,
        "history_keyed": nw.net_worth_history(t["accounts"], t["snapshots"], ["household_id"]),
        "forecast": fc.forecast(history), "payslips": ps.payroll_lines(t["grids"])}


@pytest.fixture(scope="module")
def plans(stored):
    return {n: plan(df) for n, df in every_operator(stored).items()}


def test_no_nested_loops_and_no_python(plans):
    for name, text in plans.items():
        assert not re.search(r"NestedLoop|Cartesian|Python|ArrowEval|InPandas|InArrow", text), name


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def test_each_input_is_scanned_once(plans):
    wanted = {"cashflow": 1, "totals": 1, "breakdown": 2, "savings": 2, "recon": 3, "current": 2,
              "history": 2, "payslips": 1}
    assert {n: scans(plans[n]) for n in wanted} == wanted


def test_checks_are_not_shuffled_without_keys(plans):
    for name in ("recon", "savings"):
        assert re.search(r"BroadcastHashJoin \[check_date#\d+\], .*LeftOuter, BuildRight", plans[name])
        joined = plans[name].split("BroadcastHashJoin", 1)[1].split("BroadcastExchange", 1)[0]
        assert "Exchange" not in joined


def test_payslips_are_not_shuffled_or_sorted(plans):
    assert not re.search(r"Exchange|Sort|Window", plans["payslips"])


def test_category_shares_read_the_transactions_once(stored):
    for keys in ((), ("entity_id",)):
        df = tx.spending_by_category(stored["txns"], keys)
        df.collect()
        final = plan(df).split("Initial Plan")[0]
        assert "ReusedExchange" in final and scans(final) == 1 and "Window" not in final


def test_money_flow_moves_the_items_once(stored):
    """Level 2 adds up the rows of level 3 from the same exchange; keyed or not, the transactions are scanned once."""
    for keys in ((), ("entity_id",)):
        df = flows._spending_edges(stored["txns"], None, (2, 3), keys)
        df.collect()
        final = plan(df).split("Initial Plan")[0]
        assert "ReusedExchange" in final and scans(final) == 1 and "Expand" not in final, keys
    edges = flows.money_flow_edges(stored["totals"], stored["lines"], stored["txns"])
    edges.collect()
    assert scans(plan(edges).split("Initial Plan")[0]) == 3


def test_waterfall_reads_the_transactions_once(stored):
    df = flows.waterfall_steps(stored["totals"], stored["lines"], stored["txns"], include_spending=True)
    below = plan(df).split("Window", 1)[1]
    assert len(re.findall(r"FileScan parquet.*category_group", plan(df))) == 1
    assert "rangepartitioning" not in below


def test_probes_use_no_range_join(stored):
    probes = stored["snapshots"].select("household_id", "account_id", F.col("snapshot_date").alias("as_of_date"))
    for df in (nw.balances_as_of(probes, stored["snapshots"], ["household_id"]),
               nw.net_worth_as_of(probes, stored["accounts"], stored["snapshots"], ["household_id"])):
        assert not re.search(r"NestedLoop|Cartesian|Python", plan(df))


def test_a_huge_group_is_numbered_by_many_tasks(spark):
    """Two thirds of all rows in one group, half of them alike: whole numbers, and no range holds a third of them."""
    n = 60_000
    hot = F.col("id") % 3 < 2
    df = spark.range(n).repartition(6).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        F.when(hot & (F.col("id") % 2 == 0), "same").otherwise(F.col("id").cast("string")).alias("name"))
    kept = []

    def keep(rows, name):
        kept.append(staged(rows, scratch_path(spark, name)))
        return kept[-1]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 60,000 rows would fit in one task
    try:
        got = numbered(df, ["g"], ["name"], keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = [r["count"] for r in kept[0].where("g = 'hot'").groupBy("__range").count().collect()]
    assert len(ranges) >= 4 and max(ranges) < n / 3
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.at, r.name))
    assert sum(map(len, groups.values())) == n
    for rows in groups.values():
        rows.sort()
        assert [a for a, _ in rows] == list(range(1, len(rows) + 1))
        assert [x for _, x in rows] == sorted(x for _, x in rows)


def test_aggregates_combine_before_the_shuffle(plans):
    for name in ("cashflow", "categories", "totals", "edges", "recon", "current", "history"):
        assert "partial_" in plans[name], name


def test_filters_reach_the_scan(stored):
    text = stored["lines"].sparkSession._jvm.PythonSQLUtils.explainString(
        flows.money_flow_edges(stored["totals"], stored["lines"], stored["txns"], ["1996-01"])
        ._jdf.queryExecution(), "formatted")
    pushed = " ".join(re.findall(r"PushedFilters: \[.*\]", text))
    assert "GreaterThanOrEqual(check_date,1996-01-01)" in pushed
    assert "LessThan(transaction_date,1996-02-01)" in pushed
    assert "EqualTo(flow_category,expense)" in pushed


def test_a_section_is_a_partition(spark, stored, tmp_path):
    from cashweave.sources import store
    store.write_full(stored["lines"], str(tmp_path / "lines"), ["section"])
    text = plan(pay.section_table(store.read_table(spark, str(tmp_path / "lines")), "earnings"))
    assert re.search(r"PartitionFilters: \[isnotnull\(section#\d+\), \(section#\d+ = earnings\)\]", text)


@pytest.mark.parametrize("keys", [(), ("employee_id",)])
def test_a_third_of_all_rows_on_one_key(spark, keys):
    """One employee and day holds a third of the deposits and of the checks: still whole results."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    who = F.when(hot, "hot").otherwise((F.col("id") % 500).cast("string"))
    date = F.when(hot, F.lit("2024-01-05")).otherwise(F.date_add(F.lit("2024-01-01"), (F.col("id") % 300).cast("int")))
    base = spark.range(n).select("id", who.alias("employee_id"), date.cast("date").alias("check_date"))
    money = [F.lit(1).cast("decimal(12,2)").alias(c) for c in ("gross_pay", "net_pay", "pre_tax_deductions",
                                                              "employee_taxes", "post_tax_deductions")]
    totals = base.select("*", *money)
    paid = base.select("employee_id", "check_date", F.lit("Checking").alias("account_name"),
                       F.lit(1).cast("decimal(12,2)").alias("deposit_amount"))
    txns = base.select("employee_id", F.col("check_date").alias("transaction_date"),
                       F.lit(True).alias("is_paycheck_deposit"), F.lit(1).cast("decimal(12,2)").alias("amount"))
    got = rec.reconcile(totals, paid, txns, days=0, keys=keys)
    assert got.count() == n
    # With a window of one day, what was deposited and what was recorded agree on every check.
    assert got.where("status <> 'MATCH'").count() == 0
    assert got.where("check_date = '2024-01-05'").agg(F.max("budgeted_deposits")).first()[0] >= n / 3
