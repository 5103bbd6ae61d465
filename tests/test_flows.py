import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from cashweave.operators import flows, payroll as pay, spending as sp, transactions as tx
from cashweave.schemas import TRANSACTIONS, TRANSACTIONS_RAW, conform
from .conftest import day, dec, rows
from .test_payroll import line, payroll, total


def raw(spark, *data):
    """``(date, group, item, type, amount, merchant)`` bronze rows."""
    df = spark.createDataFrame(
        [(day(d), g, i, t, dec(a), m) for d, g, i, t, a, m in data],
        "transaction_date date, category_group string, category_item string, transaction_type string, "
        "amount decimal(12,2), merchant string")
    return conform(df, TRANSACTIONS_RAW)


@pytest.fixture(scope="module")
def txns(spark):
    return tx.clean_silver(raw(
        spark, ("2024-01-02", "Food", "Out", "expense", -30, "Ann's Café"),
        ("2024-01-03", "Food", "Out", "expense", 10, "Refund_10%"), ("2024-01-04", "Food", None, "expense", -20, None),
        ("2024-02-04", "Car", "Fuel", "expense", -40, "GAS"), ("2024-02-05", "Car", "Fund", "fund", -99, "x"),
        ("2024-02-06", "Misc", "Adj", "Expense", -5, "y"), ("2024-02-07", "Income", "Paycheck 1", "income", 500, "Co")))


@pytest.fixture(scope="module")
def lines(spark):
    return payroll(spark, total("Gross Pay", 100), total("Net Pay", 60), total("Employee Taxes", 25),
                   line("employee_taxes", "Dues", 20), line("employee_taxes", "Tax", 5),
                   line("pre_tax_deductions", "Dues", 15))


def test_silver_has_the_declared_columns(txns):
    assert [(f.name, f.dataType) for f in txns.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]


def test_other_stays_in_cashflow_and_transfers_do_not(txns):
    got = {(r.year_month, r.flow_category): r.transaction_count for r in tx.monthly_cashflow(txns).collect()}
    assert got == {("2024-01", "expense"): 3, ("2024-02", "expense"): 1, ("2024-02", "other"): 1,
                   ("2024-02", "income"): 1}


def test_refunds_add_to_spending_and_null_items_are_a_category(txns):
    got = {(r.year_month, r.category_item): (r.total_spent, r.pct_of_month)
           for r in tx.spending_by_category(txns).collect()}
    assert got == {("2024-01", "Out"): (dec(40), dec(66.67)), ("2024-01", None): (dec(20), dec(33.33)),
                   ("2024-02", "Fuel"): (dec(40), dec(100))}


def test_undated_spending_forms_a_month_of_its_own(spark):
    df = tx.clean_silver(raw(spark, (None, "A", "x", "expense", -1, ""), (None, "A", "y", "expense", -3, "")))
    assert sorted(rows(tx.spending_by_category(df).select("year_month", "pct_of_month"))) == [
        (None, dec(25)), (None, dec(75))]


def test_share_of_a_month_of_zeros_is_null(spark):
    df = tx.clean_silver(raw(spark, ("2024-01-01", "A", "x", "expense", 0, "")))
    assert rows(tx.spending_by_category(df).select("total_spent", "pct_of_month")) == [(dec(0), None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abc"), st.integers(1, 10 ** 6)), min_size=1, max_size=30))
def test_shares_of_a_month_add_up(spark, data):
    df = tx.clean_silver(raw(spark, *[(f"2024-0{m}-01", g, g, "expense", -a / 100, "") for m, g, a in data]))
    got = {}
    for r in tx.spending_by_category(df).collect():
        got[r.year_month] = got.get(r.year_month, 0) + r.pct_of_month
    assert all(abs(v - 100) <= Decimal("0.03") for v in got.values())


def test_edges(spark, lines, txns):
    got = flows.money_flow_edges(pay.paycheck_totals(lines), lines, txns)
    assert sorted(((r.level, r.source_node, r.target_node, r.amount) for r in got.collect()), key=str) == sorted([
        (1, "Gross Pay", "Dues", dec(20)), (1, "Gross Pay", "Tax", dec(5)), (1, "Gross Pay", "Dues", dec(15)),
        (1, "Gross Pay", "Take-Home", dec(60)), (2, "Take-Home", "Food", dec(60)), (2, "Take-Home", "Car", dec(40)),
        (3, "Food", "Out", dec(40)), (3, "Food", None, dec(20)), (3, "Car", "Fuel", dec(40))], key=str)
    r = got.where("target_node = 'Food'").first()
    assert (r.first_date, r.last_date, r.flow_type) == (day("2024-01-02"), day("2024-01-04"), "spending")


def test_edge_filters(spark, lines, txns):
    totals = pay.paycheck_totals(lines)
    got = flows.money_flow(totals, lines, txns, months=["2024-02"], levels=[2, 3])
    assert rows(got) == [("Take-Home", "Car", dec(40), 2), ("Car", "Fuel", dec(40), 3)]
    with pytest.raises(ValueError):
        flows.money_flow_edges(totals, lines, txns, levels=[])


def test_take_home_edge_exists_without_data(spark):
    df = payroll(spark)
    got = flows.money_flow_edges(pay.paycheck_totals(df), df, tx.clean_silver(raw(spark)))
    assert rows(got) == [("Gross Pay", "Take-Home", None, 1, "paycheck", None, None)]
    assert flows.money_flow(pay.paycheck_totals(df), df, tx.clean_silver(raw(spark))).count() == 0


def test_waterfall(spark, lines, txns):
    totals = pay.paycheck_totals(lines)
    short = flows.waterfall_steps(totals, lines, txns)
    assert rows(short.select("label", "amount", "balance")) == [
        ("Gross Pay", dec(100), dec(100)), ("Taxes", dec(-25), dec(75)), ("Pre-Tax Ded.", dec(0), dec(75)),
        ("Post-Tax Ded.", dec(0), dec(75)), ("Take-Home", dec(0), dec(75))]
    full = flows.waterfall_steps(totals, lines, txns, detail=True, include_spending=True)
    assert rows(full.select("step", "label", "balance", "measure")) == [
        (1, "Gross Pay", dec(100), "absolute"), (2, "Dues", dec(80), "relative"), (3, "Tax", dec(75), "relative"),
        (4, "Dues", dec(60), "relative"), (5, "Take-Home", dec(60), "total"), (6, "Food", dec(0), "relative"),
        (7, "Car", dec(-40), "relative"), (8, "Remaining", dec(-40), "total")]
    assert flows.waterfall_steps(totals, lines, txns, months=["2023-01"]).count() == 0
    quiet = flows.waterfall_steps(totals, lines, txns.where("false"), include_spending=True)
    assert [r.label for r in quiet.collect()][-1] == "Take-Home"


def test_available_months(spark, lines, txns):
    undated = txns.unionByName(tx.clean_silver(raw(spark, (None, "A", "x", "expense", 1, ""))))
    totals = pay.paycheck_totals(lines)
    assert [r.year_month for r in flows.available_months(undated, totals).collect()] == ["2024-02", "2024-01"]


@pytest.mark.parametrize("filters, n", [
    ({}, 6), ({"flow": "All"}, 7), ({"flow": "Expenses only"}, 4), ({"flow": "Income only"}, 1),
    ({"months": ["2024-01"]}, 3), ({"months": []}, 6), ({"groups": ["Car"], "flow": "All"}, 2),
    ({"groups": ["Car"]}, 1), ({"merchant": "CAFÉ"}, 1), ({"merchant": "10%"}, 1), ({"merchant": "a%é"}, 0),
    ({"merchant": "a%é", "wildcards": True}, 1), ({"merchant": "n's"}, 1), ({"merchant": "_"}, 1)])
def test_search(txns, filters, n):
    assert tx.search_transactions(txns, **filters).count() == n
    assert tx.search_totals(txns, **filters).first().transactions == n


def test_search_refuses_unknown_mode(txns):
    with pytest.raises(ValueError):
        tx.search_transactions(txns, flow="Some")


def test_search_totals(txns):
    assert rows(tx.search_totals(txns)) == [(6, dec(500), dec(100))]
    assert rows(tx.search_totals(txns, merchant="nobody")) == [(0, dec(0), dec(0))]


def test_spending_reports_accept_both_frames(txns):
    for cats in (tx.category_totals(txns), tx.spending_by_category(txns)):
        assert rows(sp.top_categories(cats, n=2)) == [("Car", "Fuel", dec(40)), ("Food", "Out", dec(40))]
        k = sp.spending_kpis(cats, ["2024-01"]).first()
        assert (k.total, k.months, k.unique_items, k.txns, k.monthly_average) == (dec(60), 1, 1, 3, dec(60))
        assert [(r.category_group, float(r.pct)) for r in sp.spending_mix(cats).collect()] == [
            ("Food", 60), ("Car", 40)]
    none = sp.spending_kpis(tx.category_totals(txns), []).first()
    assert (none.total, none.months, none.monthly_average) == (None, 0, None)
