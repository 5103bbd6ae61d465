"""From files to gold tables and views."""

import os

import pytest
from pyspark.sql import functions as F

from cashweave.operators import health, networth as nw, reconciliation as rec, transactions
from cashweave.plans import refresh
from cashweave.schemas import (ACCOUNT_DEFINITIONS, BALANCE_SNAPSHOTS, LOAD_REPORT, PAYROLL_LINES, REJECTS,
                               TRANSACTIONS_RAW)
from cashweave.session import setting, shared_dir
from cashweave.sources import registry, store
from fixtures.derive import workbook_bytes
from .conftest import day, dec, plan, rows
from .test_csv import NEW, OLD
from .test_payslips import GRID


def test_files_to_views(spark, tmp_path):
    csvs, sheets = tmp_path / "csv", tmp_path / "xlsx"
    csvs.mkdir(), sheets.mkdir()
    (csvs / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,Ann Tulsa OK,-30.00,\n"
                                  "Income,Paycheck 1,income,01/06/2024,Co,790.00,\n")
    (csvs / "feb.csv").write_text(NEW + "Car,Fuel,expense,02/02/2024,Gas,Visa,-10.00,\n")
    deposit = [["Payment Information"], ["Bank", "Account Name", "Amount"], ["Bank A", "Checking", "790.50"],
               ["Bank B", "Roth IRA", "9.50"]]
    (sheets / "p.xlsx").write_bytes(workbook_bytes(GRID + deposit))
    t = refresh.Tables(str(tmp_path / "db"))

    for _ in range(2):  # loading again changes nothing
        refresh.ingest_transactions(spark, str(csvs), t)
        refresh.ingest_payslips(spark, str(sheets), t)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    raw = store.read_loads(spark, t.bronze("transactions_raw"), TRANSACTIONS_RAW)
    assert sorted(rows(health.load_report(raw)), key=str) == [("feb.csv", "Visa", 1), ("jan.csv", None, 2)]
    assert [r.transaction_date for r in health.newest_transactions(raw, 1).collect()] == [day("2024-02-02")]
    lines = store.read_loads(spark, t.bronze("payroll_lines"), PAYROLL_LINES)
    assert lines.count() == 6 and health.newest_payroll_lines(lines, 4).count() == 4

    registry_path, snapshots_path = t.silver("account_definitions"), t.bronze("balance_snapshots")
    empty = store.read_table(spark, registry_path, ACCOUNT_DEFINITIONS)
    asked = spark.createDataFrame([("Bank A", "checking")], "name string, account_type string")
    store.append_rows(registry.new_accounts(empty, asked), registry_path)
    again = registry.new_accounts(store.read_table(spark, registry_path, ACCOUNT_DEFINITIONS), asked)
    assert rows(again.select("account_id")) == [("acct_bank_a-2",)]  # a request is an account, whatever its name
    entered = spark.createDataFrame([("acct_bank_a", day("2024-01-31"), dec(50)), ("acct_bank_a", day("2024-02-29"), dec(70))],
                                    "account_id string, snapshot_date date, balance decimal(14,2)")
    store.append_rows(registry.new_snapshots(entered), snapshots_path)

    refresh.register_views(spark, t)
    assert rows(spark.sql("select status, variance, roth_ira_deposit from paycheck_reconciliation")) == [
        ("MATCH", dec(0.5), dec(9.5))]
    assert rows(spark.sql("select merchant_clean, account from transactions where flow_category = 'expense' "
                          "order by transaction_date")) == [("Ann", None), ("Gas", "Visa")]
    assert spark.sql("select * from monthly_cashflow").count() == 3
    assert spark.sql("select * from money_flow_edges").count() == 7
    assert rows(spark.sql("select net_worth from net_worth_summary")) == [(dec(70),)]
    assert rows(spark.sql("select net_worth from net_worth_history order by as_of_date")) == [(dec(50),), (dec(70),)]
    counts = health.table_counts(*(spark.table(n) for n in ("monthly_cashflow", "spending_by_category", "savings_rate",
                                                            "money_flow_edges")))
    assert [r.value for r in counts.collect()] == [3, 2, 1, 7]

    # Deleting a snapshot writes a new version without it.
    kept = store.read_table(spark, snapshots_path, BALANCE_SNAPSHOTS)
    wrong = kept.where("balance = 70").select("snapshot_id")
    store.write_full(store.delete_by_key(kept, wrong, ["snapshot_id"]), snapshots_path)
    accounts = store.read_table(spark, registry_path, ACCOUNT_DEFINITIONS)
    left = store.read_table(spark, snapshots_path, BALANCE_SNAPSHOTS)
    assert nw.net_worth_summary(accounts, left).first().net_worth == dec(50)
    assert left.where(F.col("entered_at").isNull()).count() == 0


def test_bad_files_are_listed_and_stop_no_other(spark, tmp_path):
    csvs, sheets = tmp_path / "csv", tmp_path / "xlsx"
    csvs.mkdir(), sheets.mkdir()
    (csvs / "good.csv").write_text(OLD + "Food,Out,expense,01/02/2024,M,-30.00,\nFood,Out,expense,soon,M,much,\n")
    (csvs / "odd.csv").write_text("a,b\n1,2\n")
    (sheets / "p.xlsx").write_bytes(workbook_bytes(GRID))
    (sheets / "broken.xlsx").write_bytes(b"no zip")
    t = refresh.Tables(str(tmp_path / "db"))
    refresh.ingest_transactions(spark, str(csvs), t)
    refresh.ingest_payslips(spark, str(sheets), t)
    assert store.read_loads(spark, t.bronze("transactions_raw"), TRANSACTIONS_RAW).count() == 2
    assert store.read_loads(spark, t.bronze("payroll_lines"), PAYROLL_LINES).count() > 0
    rejects = store.read_table(spark, t.bronze("rejects"), REJECTS)
    assert sorted((r.source_file, r.reason.split(":")[0]) for r in rejects.collect()) == [
        ("broken.xlsx", "not a readable workbook"), ("good.csv", "unreadable date, unreadable amount"),
        ("odd.csv", "unknown layout")]
    assert '"Amount":"much"' in rejects.where("source_file = 'good.csv'").first()["item"]
    report = store.read_table(spark, t.bronze("load_report"), LOAD_REPORT)
    assert sorted(rows(report.select("source_file", "rows")))[0] == ("good.csv", 2)
    assert {r.source_file for r in report.collect()} == {"good.csv", "p.xlsx"}


def test_registry_and_balance_jobs(spark, tmp_path):
    t = refresh.Tables(f"{tmp_path}/lake")
    seeds = spark.createDataFrame([("a", "Mine", "checking")], "account_id string, name string, account_type string")
    for _ in range(2):
        refresh.seed_accounts(spark, seeds, t)
    asked = spark.createDataFrame([("Roth", "retirement"), ("Boat", "boat")], "name string, account_type string")
    assert rows(refresh.add_accounts(spark, asked, t).select("name", "reason")) == [("Boat", "unknown account type")]
    entered = spark.createDataFrame([("a", day("2024-01-31"), dec(50)), ("acct_roth", day("2024-01-31"), dec(70)),
                                     ("a", day("2024-02-01"), dec(900))],
                                    "account_id string, snapshot_date date, balance decimal(14,2)")
    refresh.enter_balances(entered, t)
    stored = store.read_table(spark, t.bronze("balance_snapshots"), BALANCE_SNAPSHOTS)
    refresh.delete_snapshots(stored.where("balance = 900").select("snapshot_id"), t)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    refresh.register_views(spark, t)
    assert rows(spark.sql("select net_worth, liquid_cash from net_worth_summary")) == [(dec(120), dec(50))]


def test_two_households_from_files_to_gold(spark, tmp_path):
    """Equal file names, account names and employee numbers in both; each household's rows stay its own."""
    t = refresh.Tables(str(tmp_path / "db"), ("household_id",))
    for who, amount in (("h1", 790), ("h2", 400)):
        for kind in ("csv", "xlsx"):
            (tmp_path / kind / f"household_id={who}").mkdir(parents=True)
        (tmp_path / "csv" / f"household_id={who}" / "jan.csv").write_text(
            OLD + f"Income,Paycheck 1,income,01/06/2024,Co,{amount}.00,\nFood,Out,expense,01/02/2024,Ann,-{amount / 10},\n")
        (tmp_path / "xlsx" / f"household_id={who}" / "p.xlsx").write_bytes(workbook_bytes(
            GRID + [["Payment Information"], ["Bank", "Account Name", "Amount"], ["Bank A", "Checking", "790.50"]]))
    for _ in range(2):
        assert refresh.ingest_transactions(spark, str(tmp_path / "csv"), t) == {"rows": 4, "rejects": 0}
        refresh.ingest_payslips(spark, str(tmp_path / "xlsx"), t)
    asked = spark.createDataFrame([("h1", "Bank A", "checking"), ("h2", "Bank A", "checking")],
                                  "household_id string, name string, account_type string")
    refresh.add_accounts(spark, asked, t)
    refresh.enter_balances(spark.createDataFrame(
        [("h1", "acct_bank_a", day("2024-01-31"), dec(50)), ("h2", "acct_bank_a", day("2024-01-31"), dec(70))],
        "household_id string, account_id string, snapshot_date date, balance decimal(14,2)"), t)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    refresh.register_views(spark, t)
    def view(sql):
        return rows(spark.sql(f"select household_id, {sql} order by all"))
    assert view("status, variance from paycheck_reconciliation") == [("h1", "MATCH", dec(0.5)), ("h2", "INVESTIGATE", dec(390.5))]
    assert view("total_spent, pct_of_month from spending_by_category") == [("h1", dec(79), 100), ("h2", dec(40), 100)]
    assert view("count(*) from money_flow_edges group by 1") == [("h1", 5), ("h2", 5)]
    assert view("count(*) from paycheck_breakdown group by 1") == view("count(*) from paycheck_breakdown group by 1")
    assert view("net_worth from net_worth_summary") == [("h1", dec(50)), ("h2", dec(70))]
    assert view("source_file, count(*) from transactions group by all") == [("h1", "jan.csv", 2), ("h2", "jan.csv", 2)]
    report = store.read_table(spark, t.bronze("load_report"))
    assert report.where("household_id IS NULL").count() == 0 and report.count() == 8
    (tmp_path / "csv" / "household_id=h1" / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,Ann,-1.00,\n")
    refresh.ingest_transactions(spark, str(tmp_path / "csv" / "household_id=h1"), t)
    raw = store.read_loads(spark, t.bronze("transactions_raw"), TRANSACTIONS_RAW, t.keys)
    assert sorted(rows(raw.groupBy("household_id").agg(F.count("*")))) == [("h1", 1), ("h2", 2)]


def bronze(spark, t, households, days=40):
    """Two layers of bronze: a check and three transactions per household and every tenth day; one household is NULL."""
    at = spark.range(days).selectExpr("date_add(date '2024-01-01', cast(id * 10 as int)) day", "id")
    who = spark.range(households).selectExpr("if(id = 0, null, concat('h', id)) household_id", "id who")
    every = at.crossJoin(who)
    kinds = [("Income", "Paycheck 1", "income", 900), ("Food", "Out", "expense", -30), ("Car", "Gas", "expense", -20)]
    for n, (group, item, kind, amount) in enumerate(kinds):
        batch = every.select("household_id", F.col("day").alias("transaction_date"), F.lit(group).alias("category_group"),
                             F.lit(item).alias("category_item"), F.lit(kind).alias("transaction_type"), F.lit("M").alias("merchant"),
                             (F.col("who") + amount).cast("decimal(12,2)").alias("amount"), F.lit(f"{n}.csv").alias("source_file"))
        store.replace_by_file(batch, t.bronze("transactions_raw"), TRANSACTIONS_RAW, t.keys)
    metrics = [("totals", "Gross Pay", 1000), ("totals", "Net Pay", 900), ("pre_tax_deductions", "401k", 50),
               ("payment_information", "Bank", 900)]
    lines = every.select("household_id", "who", F.col("day").alias("check_date"), F.col("id").cast("string").alias("check_number"),
                         F.posexplode(F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("description"),
                                                         F.lit(c).cast("decimal(12,2)").alias("amount")) for a, b, c in metrics))))
    lines = lines.select("household_id", F.lit("e").alias("employee_id"), "check_date", "check_number",
                         F.col("pos").alias("row_no"), "col.*", F.lit("Checking").alias("account_name"), F.lit("p.xlsx").alias("source_file"))
    store.replace_by_file(lines, t.bronze("payroll_lines"), PAYROLL_LINES, t.keys)


def exchanges(df):
    return plan(df).count("Exchange hash")


def test_silver_is_written_without_moving_rows(spark, tmp_path, monkeypatch):
    """Without buckets, the tasks that read bronze write the months and sections; files are compressed with zstd."""
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",))
    bronze(spark, t, 3)
    whole, deals = store.write_full, []

    def watched(df, path, *args):
        if args[0]:
            deals.append(args[1:])
        return whole(df, path, *args)

    monkeypatch.setattr(store, "write_full", watched)
    refresh.refresh_silver(spark, t)
    assert deals == [(False,)] * 2
    silver = refresh.silver_tables(spark, t)
    assert silver["transactions"].count() == 3 * 40 * 3 and silver["payroll_lines"].count() == 4 * 40 * 3
    assert silver["transactions"].where("year_month <> date_format(transaction_date, 'yyyy-MM') OR year_month IS NULL").count() == 0
    names = [n for folder, _, found in os.walk(tmp_path) for n in found if n.endswith(".parquet") and "_published" not in folder]
    assert names and all(n.endswith(".zstd.parquet") for n in names)


def test_bucketed_layers_hold_the_same_rows_and_need_no_exchange(spark, tmp_path):
    plain = refresh.Tables(f"{tmp_path}/plain", ("household_id",))
    bucketed = refresh.Tables(f"{tmp_path}/it's", ("household_id",), buckets=4)
    for t in (plain, bucketed):
        bronze(spark, t, 6)
        refresh.refresh_silver(spark, t)
        refresh.refresh_gold(spark, t)
    assert {n for _, n in store.published(spark, bucketed.layer("gold")).values()} == {4}
    assert {n for _, n in store.published(spark, plain.layer("gold")).values()} == {None}
    for of in (refresh.silver_tables, refresh.gold_tables):
        ours, theirs = of(spark, bucketed), of(spark, plain)
        for name in theirs:
            assert ours[name].columns == theirs[name].columns and ours[name].dtypes == theirs[name].dtypes
            drop = [c for c in ("ingest_ts",) if c in ours[name].columns]
            a, b = (sorted(map(str, f.drop(*drop).collect())) for f in (ours[name], theirs[name]))
            assert a == b and len(a) > 0, name
    with refresh.by_entity(spark), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # as if all were large
        frames = refresh.gold_frames(*refresh.silver_tables(spark, bucketed).values(), bucketed.keys)
        joined = ("paycheck_reconciliation", "savings_rate")
        assert {n for n, f in frames.items() if exchanges(f)} == set(refresh.MOVED)
        assert all("Join" in plan(frames[n]) and "Bucketed: true" in plan(frames[n]) for n in joined)
        per_day = rec.sum_within_days(refresh.silver_tables(spark, bucketed)["paycheck_totals"],
                                      refresh.silver_tables(spark, bucketed)["transactions"], "check_date", "transaction_date",
                                      "amount", keys=bucketed.keys)
        assert exchanges(per_day) == 0 and per_day.where("income_near IS NULL AND household_id IS NOT NULL").count() == 0
        plainly = refresh.gold_frames(*refresh.silver_tables(spark, plain).values(), plain.keys)
        assert all(exchanges(plainly[n]) > 0 for n in joined)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    # Months are still pruned, and gold is grouped by entity without an exchange.
    silver = refresh.silver_tables(spark, bucketed)["transactions"].where("year_month = '2024-02'")
    assert "PartitionFilters: [isnotnull(year_month" in plan(silver) and silver.count() == 6 * 2 * 3
    assert exchanges(refresh.gold_tables(spark, bucketed)["savings_rate"].groupBy("household_id").count()) == 0
    # Another session, whose catalog knows nothing of the tables, reads them alike.
    other = refresh.gold_tables(spark.newSession(), bucketed)["savings_rate"]
    assert other.count() == 240


def test_gold_frames_share_rows_dealt_out_by_entity_once(spark, tmp_path, monkeypatch):
    """Without buckets, groupings, windows and joins by entity need no exchange of their own, null-safe ones included; with an
    outsized entity the frames start from the tables as they are. The rows are the same."""
    monkeypatch.setattr(refresh, "SMALL_PART", 100)
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",))
    bronze(spark, t, 16, days=10)
    refresh.refresh_silver(spark, t)
    silver = refresh.silver_tables(spark, t).values()
    found, moved = {}, ("monthly_cashflow", "spending_by_category", "paycheck_reconciliation", "savings_rate")
    with refresh.by_entity(spark), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for even in (True, False):
            monkeypatch.setattr(store, "is_even", lambda *_, even=even: even)
            with refresh.frames_by_entity(spark, *silver, t.keys) as frames:
                found[even] = {n: (f.columns, sorted(map(str, f.collect()))) for n, f in frames.items()}
                again = {n: plan(frames[n].select("*")) for n in moved}  # planned when what is kept is there
                assert [n for n in moved if "ENSURE_REQUIREMENTS" in again[n]] == ([] if even else list(moved))
    assert found[True] == found[False] and all(rows_ for _, rows_ in found[True].values())
    assert any("household_id=None" in r for r in found[True]["spending_by_category"][1])


def test_a_table_with_one_large_entity_is_read_plainly(spark, tmp_path, monkeypatch):
    """One household of 16 comes to hold more than four times the mean bucket of transactions."""
    monkeypatch.setattr(store, "SMALL", 10)
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",), buckets=8)
    bronze(spark, t, 16, days=10)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    assert [n for layer in ("silver", "gold") for _, n in store.published(spark, t.layer(layer)).values()] == [8] * 9
    before = {n: f.count() for n, f in refresh.gold_tables(spark, t).items()}
    raw = store.read_loads(spark, t.bronze("transactions_raw"), TRANSACTIONS_RAW, t.keys).drop(store.LOAD)
    copies = raw.where("household_id = 'h1'").withColumn("source_file", F.concat(F.lit("x"), "source_file"))
    store.replace_by_file(copies.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("n"),
                          t.bronze("transactions_raw"), TRANSACTIONS_RAW, t.keys)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    assert [n for _, n in store.published(spark, t.layer("silver")).values()] == [None, 8, 8]
    assert {n for _, n in store.published(spark, t.layer("gold")).values()} == {None}
    assert {n: f.count() for n, f in refresh.gold_tables(spark, t).items()} == before
    assert refresh.silver_tables(spark, t)["transactions"].count() == 16 * 10 * 3 + 20 * 10 * 3


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """640 payroll lines and 480 transactions: 4 buckets would hold 160 lines each, 16 hold 40."""
    counts = {}
    for most, expected in ((1_000_000, 4), (50, 16)):
        monkeypatch.setattr(store, "BUCKET", most)
        t = refresh.Tables(f"{tmp_path}/{expected}", ("household_id",), buckets=4)
        bronze(spark, t, 16, days=10)
        refresh.refresh_silver(spark, t)
        refresh.refresh_gold(spark, t)
        assert [n for layer in ("silver", "gold") for _, n in store.published(spark, t.layer(layer)).values()] == [expected] * 9
        counts[expected] = {n: sorted(map(str, f.collect())) for n, f in refresh.gold_tables(spark, t).items()}
    assert counts[4] == counts[16]
    assert [store.enough_buckets(4, n) for n in (0, 200, 201, 400, 401)] == [4, 4, 8, 8, 16] and store.enough_buckets(0, 10**9) == 0


def test_bucketed_tables_without_sources(spark, tmp_path):
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",), buckets=4)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    assert {n: f.count() for n, f in refresh.gold_tables(spark, t).items()} == dict.fromkeys(refresh.gold_schemas(spark, t.keys), 0)


def test_a_broken_refresh_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,Ann,-30.00,\n")
    t = refresh.Tables(str(tmp_path / "db"))
    refresh.ingest_transactions(spark, str(tmp_path / "csv"), t)
    refresh.refresh_silver(spark, t)
    refresh.refresh_gold(spark, t)
    before = {n: sorted(rows(f), key=str) for n, f in refresh.gold_tables(spark, t).items()}
    (tmp_path / "csv" / "feb.csv").write_text(OLD + "Car,Fuel,expense,02/02/2024,Gas,-10.00,\n")
    refresh.ingest_transactions(spark, str(tmp_path / "csv"), t)
    refresh.refresh_silver(spark, t)
    whole, written = store.write_full, []

    def third_fails(df, path, *args):
        written.append(path)
        if len(written) == 4:
            raise OSError("disk gone")
        return whole(df, path, *args)

    monkeypatch.setattr(store, "write_full", third_fails)
    with pytest.raises(OSError):
        refresh.refresh_gold(spark, t)
    assert {n: sorted(rows(f), key=str) for n, f in refresh.gold_tables(spark, t).items()} == before
    monkeypatch.setattr(store, "write_full", whole)
    refresh.refresh_gold(spark, t)
    assert refresh.gold_tables(spark, t)["monthly_cashflow"].count() == 2


def test_staging_folders_are_removed(spark, tmp_path):
    folder = shared_dir(spark)
    (tmp_path / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,Ann,-30.00,\n")
    before = set(os.listdir(folder))
    refresh.ingest_transactions(spark, str(tmp_path), refresh.Tables(str(tmp_path / "db")))
    assert set(os.listdir(folder)) == before


def test_empty_sources(spark, tmp_path):
    """No files at all: every job runs and every view can be read."""
    tables = refresh.Tables(f"{tmp_path}/lake")
    refresh.refresh_silver(spark, tables)
    refresh.refresh_gold(spark, tables)
    refresh.register_views(spark, tables)
    for name in (*refresh.silver_schemas(spark), *refresh.gold_schemas(spark), "net_worth_summary"):
        assert spark.table(name).count() >= 0
    assert spark.table("savings_rate").count() == 0


def test_month_reports_read_only_their_partitions(spark, tmp_path):
    table = spark.createDataFrame(
        [("2024-01", day("2024-01-05"), "Food", "M", "expense", dec(1)), ("2024-02", day("2024-02-05"), "Food", "M", "expense", dec(2))],
        "year_month string, transaction_date date, category_group string, merchant_clean string, flow_category string, "
        "amount_abs decimal(12,2)")
    store.write_full(table, f"{tmp_path}/t", ["year_month"])
    stored = store.read_table(spark, f"{tmp_path}/t", table.schema)
    for report in (transactions.spending_by_group, transactions.spending_by_merchant):
        out = report(stored, ["2024-02"])
        assert out.count() == 1
        assert "PartitionFilters: [isnotnull(year_month" in plan(out)


def test_bucketed_silver_moves_rows_as_they_are_in_bronze(spark, tmp_path, monkeypatch):
    """Dealt out by bucket before the derived columns are there; check totals and all of gold are written where their rows lie."""
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",), buckets=4)
    bronze(spark, t, 6)
    dealt, written, deal, write = [], {}, store.deal_out, store.write_bucketed

    def watched(df, *args):
        dealt.append(df.columns)
        return deal(df, *args)

    def watched_write(df, path, *args):
        written[os.path.basename(path)] = exchanges(df)
        return write(df, path, *args)

    monkeypatch.setattr(store, "deal_out", watched)
    monkeypatch.setattr(store, "write_bucketed", watched_write)
    refresh.refresh_silver(spark, t)
    assert [len(c) for c in dealt] == [len(TRANSACTIONS_RAW) + 1, len(PAYROLL_LINES) + 1] and "transaction_key" not in dealt[0]
    assert written["paycheck_totals"] == 0
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # as if all were large
        refresh.refresh_gold(spark, t)
    assert len(written) == 9 and not any(written[n] for n in refresh.gold_schemas(spark, t.keys))


@pytest.mark.parametrize("buckets", [0, 4])
def test_rows_of_a_silver_file_lie_in_the_order_of_their_days(spark, tmp_path, buckets):
    import pyarrow.parquet as pq
    t = refresh.Tables(f"{tmp_path}/db", ("household_id",), buckets)
    bronze(spark, t, 30)
    refresh.refresh_silver(spark, t)
    for name, column in refresh.ORDER.items():
        files = [os.path.join(d, f) for d, _, found in os.walk(t.silver(name)) for f in found if f.endswith(".parquet")]
        days = [pq.ParquetFile(f).read([column])[column].to_pylist() for f in files]
        assert sum(map(len, days)) and all(d == sorted(d) for d in days), name


def test_month_shares_by_window_are_those_by_join(spark):
    rows_ = [(who, f"2024-0{m}", 2024, m, "expense", group, item, dec(n))
             for n, (who, m, group, item) in enumerate((w, m, g, i) for w in ("a", None) for m in (1, 2) for g in ("x", None) for i in "pqp")]
    rows_ += [("z", "2024-01", 2024, 1, "expense", "x", "p", dec(0)), ("n", "2024-01", 2024, 1, "expense", "x", "p", None),
              ("n", None, None, None, "expense", "x", "p", dec(4)), ("a", "2024-01", 2024, 1, "income", "x", "p", dec(9))]
    df = spark.createDataFrame(rows_, "who string, year_month string, year int, month int, flow_category string, category_group string, "
                                      "category_item string, amount_abs decimal(12,2)")
    by_join, by_window = (transactions.spending_by_category(df, ["who"], by_window=w) for w in (False, True))
    assert by_join.schema == by_window.schema and exchanges(by_window) < exchanges(by_join)
    assert sorted(map(str, by_join.collect())) == sorted(map(str, by_window.collect())) and by_join.count() == 19


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    import time
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def moved():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = moved()
    rows_ = spark.range(1000).withColumn("source_file", F.lit("f")).withColumn("amount", F.lit(1)).repartition(7, "id")
    store.write_full(rows_, f"{tmp_path}/t")
    store.write_bucketed(rows_, f"{tmp_path}/b", ["id"], 2)
    store.replace_by_file(rows_, f"{tmp_path}/r", TRANSACTIONS_RAW)
    until = time.time() + 20
    while moved() - before and time.time() < until:
        time.sleep(0.2)
    assert not moved() - before
    assert store.read_table(spark, f"{tmp_path}/t").count() == 1000
