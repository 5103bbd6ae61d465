import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cashweave.operators import payroll as pay, reconciliation as rec
from cashweave.schemas import PAYROLL_LINES, TRANSACTIONS, conform
from .conftest import day, dec, rows

D = "2024-01-05"


def payroll(spark, *lines):
    """Lines as dicts over a default check."""
    base = {"employee_id": "1", "check_date": day(D), "check_number": "9", "source_file": "f", "row_no": 1}
    data = [{**base, **line, "amount": dec(line.get("amount")), "ytd": dec(line.get("ytd"))} for line in lines]
    schema = ("employee_id string, check_date date, check_number string, source_file string, row_no int, "
              "section string, description string, amount decimal(12,2), ytd decimal(14,2), "
              "account_name string, ingest_ts timestamp")
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)
    return conform(df, PAYROLL_LINES)


def total(metric, amount, ytd=None, **more):
    return {"section": "totals", "description": metric, "amount": amount, "ytd": ytd, **more}


def line(section, description, amount, **more):
    return {"section": section, "description": description, "amount": amount, **more}


def txns(spark, *deposits):
    """``(date, amount)`` pay deposits."""
    df = spark.createDataFrame([(day(d), dec(a), True) for d, a in deposits],
                               "transaction_date date, amount decimal(12,2), is_paycheck_deposit boolean")
    return conform(df, TRANSACTIONS)


def test_totals_keep_checks_with_null_keys(spark):
    df = payroll(spark, total("Gross Pay", 10, 20, check_number=None), total("Net Pay", 5, check_number=None),
                 total("Bonus", 7, check_number=None))
    got = pay.paycheck_totals(df)
    assert rows(got.select("check_number", "gross_pay", "gross_pay_ytd", "net_pay", "hours_worked")) == [
        (None, dec(10), dec(20), dec(5), None)]


def test_a_repeated_metric_counts_once_by_its_first_row(spark):
    df = payroll(spark, total("Net Pay", 2, row_no=5), total("Net Pay", 1, row_no=3))
    assert pay.paycheck_totals(df).first().net_pay == dec(1)


def test_the_same_check_in_two_files_is_two_rows_until_deduplicated(spark):
    ts = [F.to_timestamp(F.lit(t)) for t in ("2024-01-01", "2024-01-02")]
    a = payroll(spark, total("Net Pay", 1)).withColumn("ingest_ts", ts[0])
    b = payroll(spark, total("Net Pay", 2, source_file="g")).withColumn("ingest_ts", ts[1])
    other = payroll(spark, total("Net Pay", 3, check_number=None)).withColumn("ingest_ts", ts[0])
    df = a.unionByName(b).unionByName(other)
    assert pay.paycheck_totals(df).count() == 3
    assert sorted(rows(pay.dedupe_checks(df).select("source_file", "amount"))) == [("f", dec(3)), ("g", dec(2))]


def test_sections(spark):
    df = payroll(spark, line("earnings", "Regular", 1), line("withholding", "Federal", 2))
    assert pay.section_table(df, "earnings").columns[-3:] == ["hours", "rate", "date_range"]
    assert rows(pay.section_table(df, "withholding").select("description", "amount")) == [("Federal", dec(2))]


def test_savings_rate_of_zero_gross_is_null(spark):
    df = payroll(spark, total("Gross Pay", 0), line("post_tax_deductions", "401(k) Roth", 5))
    r = pay.savings_rate(pay.paycheck_totals(df), df).first()
    assert (r.posttax_savings, r.savings_rate_pct, r.total_savings_rate_pct) == (dec(5), None, None)


def test_savings_rate_parts(spark):
    df = payroll(
        spark, total("Gross Pay", 1000), line("pre_tax_deductions", "401(k) Pre-tax", 50),
        line("pre_tax_deductions", "Dental", 11), line("post_tax_deductions", "401(k) Roth", 30),
        line("payment_information", "Bank", 20, account_name="my ROTH IRA 2"),
        line("payment_information", "Bank", 99, account_name="Checking"),
        line("payment_information", "Bank", 99), line("employer_paid_benefits", "Match", 25))
    r = pay.savings_rate(pay.paycheck_totals(df), df).first()
    assert [r[b] for b in pay.SAVINGS_BUCKETS] == [dec(50), dec(30), dec(20), dec(25)]
    assert (r.savings_rate_pct, r.total_savings_rate_pct) == (dec(10), dec(12.5))
    other = pay.savings_rate(pay.paycheck_totals(df), df, pretax=["Dental"], posttax=[], roth="checking").first()
    assert [other[b] for b in pay.SAVINGS_BUCKETS] == [dec(11), dec(0), dec(99), dec(25)]


def test_deposits_without_account_name_belong_to_neither_part(spark):
    df = payroll(spark, line("payment_information", "A", 1), line("payment_information", "B", 2, account_name="x Roth IRA"),
                 line("payment_information", "C", 4, account_name="Checking"))
    assert rows(rec.deposits_per_check_date(pay.payments(df))) == [(day(D), dec(4), dec(2))]


@pytest.mark.parametrize("keys", [(), ("employee_id",)])
def test_window_bounds_and_shared_income(spark, keys):
    totals = spark.createDataFrame(
        [("1", day("2024-01-10")), ("1", day("2024-01-14")), ("1", None)], "employee_id string, check_date date")
    income = spark.createDataFrame(
        [("1", day(d), dec(a)) for d, a in (("2024-01-04", 1), ("2024-01-05", 2), ("2024-01-10", 4),
                                             ("2024-01-15", 8), ("2024-01-16", 16), ("2024-01-20", 32))],
        "employee_id string, d date, amount decimal(12,2)")
    got = rec.sum_within_days(totals, income, "check_date", "d", "amount", keys=keys)
    assert {r.check_date: r.income_near for r in got.collect()} == {
        day("2024-01-10"): dec(14), day("2024-01-14"): dec(28), None: None}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 28)), min_size=1, max_size=12),
       st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 28), st.one_of(st.none(), st.integers(-9, 9))), max_size=12),
       st.integers(0, 9))
def test_sum_within_days_equals_brute_force(spark, checks, incomes, days):
    def date(n):
        return day(f"2024-02-{n:02}")
    left = spark.createDataFrame([(i, e, date(d)) for i, (e, d) in enumerate(checks)], "i int, e string, d date")
    right = spark.createDataFrame([(e, date(d), dec(a)) for e, d, a in incomes], "e string, t date, a decimal(12,2)")
    for keys in ((), ("e",)):
        got = rec.sum_within_days(left, right, "d", "t", "a", days, keys)
        want = {}
        for i, (e, d) in enumerate(checks):
            near = [a for o, t, a in incomes if abs(t - d) <= days and (o == e or not keys) and a is not None]
            want[i] = dec(sum(near)) if near else None
        assert {r.i: r.income_near for r in got.collect()} == want


def test_income_of_another_entity_does_not_count(spark):
    totals = spark.createDataFrame([("1", day(D)), ("2", day(D))], "employee_id string, check_date date")
    income = spark.createDataFrame([("2", day(D), dec(3))], "employee_id string, d date, amount decimal(12,2)")
    got = rec.sum_within_days(totals, income, "check_date", "d", "amount", keys=["employee_id"])
    assert {r.employee_id: r.income_near for r in got.collect()} == {"1": None, "2": dec(3)}


def test_reconcile(spark):
    df = payroll(spark, total("Gross Pay", 100), total("Net Pay", 80),
                 line("payment_information", "A", 70, account_name="Checking"),
                 line("payment_information", "B", 10, account_name="Roth IRA"))
    totals, paid = pay.paycheck_totals(df), pay.payments(df)
    r = rec.reconcile(totals, paid, txns(spark, ("2024-01-08", 60), ("2024-01-01", 9.5))).first()
    assert (r.budgeted_deposits, r.roth_ira_deposit, r.income_near_check, r.variance, r.status) == (
        dec(70), dec(10), dec(69.5), dec(0.5), "MATCH")
    r = rec.reconcile(totals, paid, txns(spark, ("2024-03-08", 60))).first()
    assert (r.income_near_check, r.variance, r.status) == (None, dec(70), "MISSING")
    r = rec.reconcile(totals, paid, txns(spark, ("2024-01-08", 60)), days=2).first()
    assert r.status == "MISSING"


def test_identical_checks_stay_apart_and_do_not_double_income(spark):
    df = payroll(spark, total("Gross Pay", 1), total("Gross Pay", 1, check_number="10"))
    got = rec.reconcile(pay.paycheck_totals(df), pay.payments(df), txns(spark, (D, 5))).collect()
    assert [r.income_near_check for r in got] == [dec(5), dec(5)]


def test_empty_inputs(spark):
    df, none = payroll(spark), txns(spark)
    totals = pay.paycheck_totals(df)
    for out in (totals, pay.paycheck_breakdown(totals, df), pay.savings_rate(totals, df),
                rec.reconcile(totals, pay.payments(df), none), pay.dedupe_checks(df)):
        assert out.count() == 0
    r = pay.pay_summary(totals).first()
    assert (r.total_gross, r.effective_rate, r.take_home_rate, r.paychecks) == (None, 0, 0, 0)
