import datetime as dt
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cashweave.operators import networth as nw
from .conftest import day, dec, rows

ACCOUNTS = "account_id string, name string, account_type string, institution string, is_active boolean, display_order int"
SNAPSHOTS = ("snapshot_id string, account_id string, snapshot_date date, balance decimal(14,2), note string, "
             "entered_at timestamp")
BUCKET = {"checking": "liquid", "hsa": "retirement", "investment": "investments"}


def accounts(spark, *data):
    """``(id, type, is_active)``."""
    return spark.createDataFrame([(a, a.upper(), t, "I", on, n) for n, (a, t, on) in enumerate(data)], ACCOUNTS)


def snapshots(spark, *data):
    """``(account, date, balance, entered hour or None)``."""
    return spark.createDataFrame(
        [(f"s{n:03}", a, day(d), dec(b), None, None if h is None else dt.datetime(2024, 1, 1, h))
         for n, (a, d, b, h) in enumerate(data)], SNAPSHOTS)


def brute_history(accs, snaps):
    """Every date against every active account, newest snapshot on or before the date."""
    out = []
    for date in sorted({s[1] for s in snaps}):
        sums, known = {"net_worth": 0, "liquid": 0, "retirement": 0, "investments": 0}, False
        for a, kind, on in accs:
            mine = [(s[1], -1 if s[3] is None else s[3], n, s[2]) for n, s in enumerate(snaps)
                    if s[0] == a and s[1] <= date]
            balance = max(mine)[3] if on and mine else None
            if balance is None:
                continue
            known = True
            sums["net_worth"] += -dec(balance) if kind == "liability" else dec(balance)
            if kind in BUCKET:
                sums[BUCKET[kind]] += dec(balance)
        if known:
            out.append((day(date), *map(Decimal, sums.values())))
    return out


def test_history_example(spark):
    accs = [("a", "checking", True), ("late", "investment", True), ("off", "checking", False),
            ("debt", "liability", True), ("car", "vehicle", True), ("none", "hsa", None)]
    snaps = [("off", "2024-01-01", 9, 1), ("a", "2024-01-02", 10, 1), ("a", "2024-01-02", 11, 2),
             ("a", "2024-01-02", 12, None), ("unknown", "2024-01-03", 5, 1), ("late", "2024-01-04", 100, 1),
             ("debt", "2024-01-05", 40, 1), ("car", "2024-01-06", 7, 1), ("a", "2024-01-07", 1, 1),
             ("none", "2024-01-08", 3, 1)]
    got = rows(nw.net_worth_history(accounts(spark, *accs), snapshots(spark, *snaps)).orderBy("as_of_date"))
    assert got == brute_history(accs, snaps)
    assert got[:2] == [(day("2024-01-02"), dec(11), dec(11), dec(0), dec(0)),
                       (day("2024-01-03"), dec(11), dec(11), dec(0), dec(0))]
    assert got[-1] == (day("2024-01-08"), dec(68), dec(1), dec(0), dec(100))


SNAP = st.tuples(st.sampled_from("abcdx"), st.integers(1, 9).map(lambda n: f"2024-01-0{n}"),
                 st.integers(-500, 500), st.sampled_from([None, 1, 2]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SNAP, min_size=1, max_size=25))
def test_history_equals_brute_force_in_any_row_order(spark, snaps):
    accs = [("a", "checking", True), ("b", "liability", True), ("c", "hsa", False), ("d", "investment", True)]
    df, reg = snapshots(spark, *snaps), accounts(spark, *accs)
    want = brute_history(accs, snaps)
    assert rows(nw.net_worth_history(reg, df.repartition(3, "balance")).orderBy("as_of_date")) == want


def test_households_do_not_mix(spark):
    from pyspark.sql import functions as F
    accs = [("a", "checking", True), ("b", "checking", True)]
    reg = accounts(spark, *accs).withColumn("h", F.col("account_id") == "a")
    df = snapshots(spark, ("a", "2024-01-01", 1, 1), ("b", "2024-01-02", 2, 1)).withColumn("h", F.col("account_id") == "a")
    got = nw.net_worth_history(reg, df, ["h"]).select("h", "as_of_date", "net_worth")
    assert sorted(rows(got)) == [(False, day("2024-01-02"), dec(2)), (True, day("2024-01-01"), dec(1))]
    total = nw.net_worth_summary(reg, df, ["h"]).select("h", "net_worth", "liquid_cash")
    assert sorted(rows(total)) == [(False, dec(2), dec(2)), (True, dec(1), dec(1))]


def test_current_and_summary(spark):
    accs = accounts(spark, ("a", "checking", True), ("b", "liability", True), ("c", "hsa", True),
                    ("d", "vehicle", True), ("e", "checking", False))
    snaps = snapshots(spark, ("a", "2024-01-02", 5, 3), ("a", "2024-01-02", 6, 4), ("a", "2024-01-01", 7, 9),
                      ("b", "2024-01-03", 2, 1), ("d", "2024-01-01", 10, 1), ("e", "2024-01-09", 99, 1))
    got = nw.latest_balances(snaps, accs).select("account_id", "as_of_date", "balance", "bucket")
    assert sorted(rows(got)) == [
        ("a", day("2024-01-02"), dec(6), "Liquid"), ("b", day("2024-01-03"), dec(2), "Liability"),
        ("c", None, None, "Retirement/Tax-Advantaged"), ("d", day("2024-01-01"), dec(10), "Other")]
    assert rows(nw.net_worth_summary(accs, snaps)) == [
        (dec(14), dec(6), dec(0), dec(0), dec(2), day("2024-01-03"))]


def test_ties_go_to_the_larger_snapshot_id(spark):
    snaps = snapshots(spark, ("a", "2024-01-02", 5, None), ("a", "2024-01-02", 6, None))
    assert nw.latest_balances(snaps, accounts(spark, ("a", "cash", True))).first().balance == dec(6)


def test_intervals(spark):
    snaps = snapshots(spark, ("a", "2024-01-02", 5, 1), ("a", "2024-01-02", 6, 2), ("a", "2024-01-04", 7, 1),
                      ("b", "2024-01-04", 7, 1))
    got = nw.as_of_balances(snaps, accounts(spark, ("a", "cash", True), ("b", "cash", False)))
    assert sorted(rows(got), key=str) == [
        ("a", "cash", day("2024-01-02"), day("2024-01-04"), dec(6)), ("a", "cash", day("2024-01-04"), None, dec(7))]


def test_log_joins_names_newest_first(spark):
    snaps = snapshots(spark, ("a", "2024-01-01", 1, 1), ("a", "2024-01-02", 2, None), ("a", "2024-01-02", 3, 5),
                      ("gone", "2024-01-09", 4, 1))
    got = nw.snapshot_log(snaps, accounts(spark, ("a", "cash", False)), n=2)
    assert rows(got.select("account", "balance")) == [("A", dec(3)), ("A", dec(2))]


def test_empty(spark):
    assert nw.net_worth_history(accounts(spark), snapshots(spark)).count() == 0
    assert rows(nw.net_worth_summary(accounts(spark), snapshots(spark))) == [(None,) * 6]
    reg = accounts(spark, ("b", "cash", True), ("a", "cash", True))
    assert [r.name for r in nw.current_balances(snapshots(spark), reg).collect()] == ["B", "A"]
    assert [r.account_id for r in nw.active_accounts(reg).collect()] == ["b", "a"]


def test_probes_against_every_snapshot(spark):
    """Days before, on, between and after the snapshots, repeated probes, unknown accounts and probes without a day."""
    rng = random.Random(5)
    snaps = [(rng.choice("abc"), f"2024-01-{rng.randint(5, 25):02}", rng.choice([None, 5, 70.25]), rng.choice([None, 1, 9]))
             for _ in range(60)]
    accs = [("a", "checking", True), ("b", "liability", True), ("c", "hsa", False)]
    asked = [(a, day(f"2024-01-{d:02}")) for a in "abcz" for d in range(1, 29, 2)] * 2 + [("a", None)]
    table = snapshots(spark, *snaps)
    probes = spark.createDataFrame(asked, "account_id string, as_of_date date")

    def newest(account, date):
        mine = [(s[1], -1 if s[3] is None else s[3], n, s[2]) for n, s in enumerate(snaps)
                if s[0] == account and date and s[1] <= str(date)]
        return max(mine, default=None)

    got = nw.balances_as_of(probes, table)
    assert got.count() == len(asked)
    for r in got.collect():
        want = newest(r.account_id, r.as_of_date)
        assert (r.snapshot_date, r.balance) == ((day(want[0]), dec(want[3])) if want else (None, None))
    history = {r.as_of_date: r for r in nw.net_worth_history(accounts(spark, *accs), table).collect()}
    when = probes.select("as_of_date")
    for r in nw.net_worth_as_of(when, accounts(spark, *accs), table).collect():
        known = [d for d in history if r.as_of_date and d <= r.as_of_date]
        want = history[max(known)] if known else None
        assert (r.net_worth, r.liquid, r.retirement) == ((want.net_worth, want.liquid, want.retirement) if want else (None,) * 3)
    assert nw.balances_as_of(probes, table.where("false")).where("balance IS NOT NULL").count() == 0


def test_probes_of_entities_stay_apart(spark):
    table = snapshots(spark, ("a", "2024-01-01", 5, 1)).withColumn("who", F.lit("x"))
    probes = spark.createDataFrame([("x", "a", day("2024-02-01")), ("y", "a", day("2024-02-01"))],
                                   "who string, account_id string, seen date")
    got = nw.balances_as_of(probes, table, ["who"], day="seen")
    assert sorted(rows(got.select("who", "balance"))) == [("x", dec(5)), ("y", None)]
