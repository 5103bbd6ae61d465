import datetime as dt

import pytest
from pyspark.sql import functions as F

from cashweave import functions as fn
from cashweave.functions import money
from cashweave.schemas import MONEY
from .conftest import day, dec, rows


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def test_direction(spark):
    df = column(spark, [dec(1), dec(-1), dec(0), None], "decimal(12,2)")
    assert [r[0] for r in rows(df.select(fn.direction("x")))] == ["inflow", "outflow", "zero", "zero"]


def test_flow_category_and_transfer(spark):
    df = column(spark, ["fund", "income", "expense", "Expense", None])
    got = rows(df.select(fn.flow_category("x"), fn.is_transfer("x")))
    assert got == [("transfer", True), ("income", False), ("expense", False), ("other", False),
                   ("other", False)]


def test_date_parts_mix_iso_week_and_calendar_year(spark):
    df = column(spark, [day("2024-12-30")], "date")
    parts = fn.date_parts("x")
    got = rows(df.select(*parts.values()))
    assert got == [(2024, 12, "2024-12", 1, "Monday", 30)]


@pytest.mark.parametrize("text, clean", [
    ("WAL-MART  #123   Tulsa OK", "WAL-MART #123"), ("Cafe Oklahoma CityOK", "Cafe"),
    ("AMZN ***** X12", "AMZN"), ("Tulsa", "Tulsa"), ("Shop Tulsa ok", "Shop Tulsa ok"),
    ("Target OK", "Target OK"), ("Store Oklahoma Cityok", "Store"), ("  a\t b  ", "a b"),
    ("Pay * ref1 Norman", "Pay"), (None, None)])
def test_merchant_clean(spark, text, clean):
    assert rows(column(spark, [text]).select(fn.merchant_clean("x"))) == [(clean,)]


def test_merchant_suffixes_are_a_parameter(spark):
    df = column(spark, ["Shop Reno NV", "Shop Tulsa OK"])
    got = rows(df.select(fn.merchant_clean("x", suffixes=["Reno"], state="NV")))
    assert got == [("Shop",), ("Shop Tulsa OK",)]
    assert rows(df.select(fn.merchant_clean("x", suffixes=[])))[0] == ("Shop Reno NV",)


def test_paycheck_deposit(spark):
    df = spark.createDataFrame([("Income", "Paycheck 1"), ("Income", "Paycheck"), ("Income", None),
                                ("Food", "Paycheck 1"), (None, "Paycheck 1"),
                                ("Income", "Paycheck 12 ")], "g string, i string")
    assert [r[0] for r in rows(df.select(fn.is_paycheck_deposit("g", "i")))] == [
        True, False, False, False, False, False]


@pytest.mark.parametrize("text, value", [
    ("$1,234.56", 1234.56), ("(12.00)", -12), ("$(3.10)", -3.10), ("-$5", -5), (" 7 ", 7), ("", None),
    ("  ", None), ("abc", None), (None, None), (" $2.50\t", 2.5), ("99999999999.00", None)])
def test_parse_money(spark, text, value):
    got = rows(column(spark, [text]).select(fn.parse_money("x", MONEY)))
    assert got == [(dec(value),)]


def test_transaction_key_skips_nulls(spark):
    df = spark.createDataFrame(
        [(day("2024-01-01"), "g", "i", None, dec(1), "f"), (day("2024-01-01"), "g", None, "i", dec(1), "f")],
        "transaction_date date, category_group string, category_item string, merchant string, "
        "amount decimal(12,2), source_file string")
    a, b = rows(df.select(fn.transaction_key()))
    assert a == b and len(a[0]) == 64


@pytest.mark.parametrize("income, status", [
    (99.01, "MATCH"), (99.00, "Minor variance"), (50.01, "Minor variance"), (50.00, "INVESTIGATE"),
    (150.00, "INVESTIGATE"), (None, "MISSING")])
def test_recon_status_bounds_are_exclusive(spark, income, status):
    df = spark.createDataFrame([(dec(100), dec(income))], "d decimal(12,2), i decimal(12,2)")
    assert rows(df.select(fn.recon_status("d", "i"))) == [(status,)]


def test_recon_label_is_a_parameter(spark):
    df = spark.createDataFrame([(dec(1), None)], "d decimal(12,2), i decimal(12,2)")
    assert rows(df.select(fn.recon_status("d", "i", missing_label="none found"))) == [("none found",)]


def test_bucket_key(spark):
    df = column(spark, ["401(k) Pre-tax"])
    assert rows(df.select(fn.bucket_key("pretax_", "x"))) == [("pretax_401(k)_pre-tax",)]


def test_account_bucket_and_sign(spark):
    df = column(spark, ["cash", "hsa", "investment", "liability", "boat", None])
    got = rows(df.select(fn.account_bucket("x"), fn.signed_balance("x", F.lit(5))))
    assert got == [("Liquid", 5), ("Retirement/Tax-Advantaged", 5), ("Investment", 5), ("Liability", -5),
                   ("Other", 5), ("Other", 5)]


def test_month_ranges_merge_neighbours():
    d = dt.date
    assert fn.month_ranges(["2023-12", "2024-01", "2024-03", "2024-01"]) == [
        (d(2023, 12, 1), d(2024, 2, 1)), (d(2024, 3, 1), d(2024, 4, 1))]


def test_in_months(spark):
    df = column(spark, [day("2023-12-31"), day("2024-01-01"), day("2024-01-31"), None], "date")
    assert df.where(fn.in_months("x", ["2024-01"])).count() == 2
    assert df.where(fn.in_months("x", None)).count() == 4
    assert df.where(fn.in_months("x", [])).count() == 0


def test_strip_looks_at_both_ends(spark):
    """The short way gives what the long one gives, for every kind of white space at either end and none."""
    ends = ["", *money.WHITE_SPACE, "\x7f", "\u200b", "é", "!", "~", "\x00"]
    texts = [a + body + b for a in ends for b in ends for body in ("", "x", "x y", "é")] + [None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", money.strip("t").alias("long"), money.strip_ends(F.col("t")).alias("short")).collect()
    assert all(r["long"] == r["short"] == (r["t"] and r["t"].strip(money.WHITE_SPACE)) for r in got)


def test_transactions_are_derived_from_line_items_with_nulls(spark, tmp_path):
    """What is packed for the way to orders and parts says the same as the columns it was made from."""
    import datetime as dt
    from fixtures import derive
    times = [None, dt.datetime(1969, 12, 31, 23), dt.datetime(1999, 2, 3), dt.datetime(1, 1, 1)]
    items = [(1, 5, 70 + n, number, price, discount, flag, status, times[n % 4])
             for n, (number, price, discount, flag, status) in enumerate(
                 (number, price, discount, flag, status) for number in (None, 0, 1, 2, 3, 4, 5, 6, 7, 8, -1)
                 for price, discount in ((10.005, 0.0), (None, 0.1), (12345678.9, None))
                 for flag, status in (("N", "O"), ("N", None), ("R", "O")))]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                                 "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 9, 100.0, times[2])], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"
                          ).where("o_orderkey = 1").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "type", "brand")], "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = derive.transactions_raw(spark, str(tmp_path)).where("category_group = 'type'")
    ends = {1: "   Tulsa OK", 2: " Norman", 3: " **** X12", 4: "  Main  St"}

    def expected(supplier, number, price, discount, flag, status, at):
        day, amount = at and at.date(), None if price is None else dec(round(price + 1e-9, 2))
        return ("9", day, "type", "brand", "fund" if (flag, status) == ("N", "O") else "adjustment" if number == 7 else "expense",
                f"Supplier#{supplier}{ends.get(number, '')}", f"acct_{supplier % 3}" if day and day.year >= 1999 else None,
                amount if number == 5 or amount is None else -amount, "n" if discount else None, f"budget_{day.year}.csv" if day else None)

    wanted = [expected(*i[2:]) for i in items]
    assert sorted(((*r[:9], r.source_file) for r in got.collect()), key=lambda r: r[5]) == sorted(wanted, key=lambda r: r[5])
