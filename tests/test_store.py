import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from cashweave.schemas import (ACCOUNT_DEFINITIONS, BALANCE_SNAPSHOTS, TRANSACTIONS_RAW, conform)
from cashweave.session import setting
from cashweave.sources import registry, store
from .conftest import day, dec, rows


def batch(spark, *files):
    """``(file, amounts)`` pairs as bronze rows."""
    data = [(f, dec(a)) for f, amounts in files for a in amounts]
    return conform(spark.createDataFrame(data, "source_file string, amount decimal(12,2)"), TRANSACTIONS_RAW)


def content(spark, path):
    df = store.read_loads(spark, path, TRANSACTIONS_RAW)
    return sorted((r.source_file, float(r.amount), r[store.LOAD]) for r in df.collect())


def test_first_load_and_new_files_only_add(spark, tmp_path):
    path = str(tmp_path / "t")
    assert content(spark, path) == []
    store.replace_by_file(batch(spark, ("a", [1, 2])), path, TRANSACTIONS_RAW)
    before = sorted((tmp_path / "t" / "load_id=0").iterdir())
    store.replace_by_file(batch(spark, ("b", [3])), path, TRANSACTIONS_RAW)
    assert content(spark, path) == [("a", 1, 0), ("a", 2, 0), ("b", 3, 1)]
    assert sorted((tmp_path / "t" / "load_id=0").iterdir()) == before


def test_loading_twice_changes_nothing(spark, tmp_path):
    path, load = str(tmp_path / "t"), batch(spark, ("a b.csv", [1, 1]), ("x'y+z%.csv", [2]))
    store.replace_by_file(load, path, TRANSACTIONS_RAW)
    once = content(spark, path)
    store.replace_by_file(load, path, TRANSACTIONS_RAW)
    assert [r[:2] for r in content(spark, path)] == [r[:2] for r in once]


def test_a_file_replaces_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_by_file(batch(spark, ("a", [1, 2]), ("b", [3])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("c", [4])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("a", [9]), ("d", [5])), path, TRANSACTIONS_RAW)
    assert content(spark, path) == [("a", 9, 2), ("b", 3, 0), ("c", 4, 1), ("d", 5, 2)]


def test_files_of_several_loads_replaced_together(spark, tmp_path):
    path = str(tmp_path / "t")
    for n, name in enumerate("abc"):
        store.replace_by_file(batch(spark, (name, [n])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("a", [10]), ("c", [30, 31])), path, TRANSACTIONS_RAW)
    assert content(spark, path) == [("a", 10, 3), ("b", 1, 1), ("c", 30, 3), ("c", 31, 3)]


def test_an_empty_batch_replaces_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_by_file(batch(spark, ("a", [1])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("a", [])), path, TRANSACTIONS_RAW)
    assert content(spark, path) == [("a", 1, 0)]


def stamps(folder):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in folder.rglob("*") if f.is_file()}


def test_replacing_one_file_of_fifty_touches_no_data(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_by_file(batch(spark, *[(f"f{n}", [n, n]) for n in range(50)]), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, (None, [7])), path, TRANSACTIONS_RAW)
    before = stamps(tmp_path / "t")
    new = store.replace_by_file(batch(spark, ("f7", [70])), path, TRANSACTIONS_RAW)
    after = stamps(tmp_path / "t")
    assert {f: after[f] for f in before} == before and new.count() == 1
    got = store.read_loads(spark, path, TRANSACTIONS_RAW)
    assert sorted((r.source_file or "", float(r.amount)) for r in got.collect()) == sorted(
        [("", 7.0), ("f7", 70.0)] + [(f"f{n}", float(n)) for n in range(50) for _ in (0, 1) if n != 7])
    stale = store.manifest(spark, path).where("NOT is_current").drop("is_current")
    assert rows(stale) == [("f7", 2, 0)]


def test_a_load_that_broke_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_by_file(batch(spark, ("a", [1])), path, TRANSACTIONS_RAW)
    conform(batch(spark, ("a", [9])), TRANSACTIONS_RAW).write.parquet(f"{path}/load_id=1")  # no entry in the manifest
    assert content(spark, path) == [("a", 1, 0)]
    store.replace_by_file(batch(spark, ("a", [2])), path, TRANSACTIONS_RAW)
    assert content(spark, path) == [("a", 2, 2)]


def test_entities_may_use_the_same_file_names(spark, tmp_path):
    path, who = str(tmp_path / "t"), ["who"]
    mine = batch(spark, ("a", [1])).withColumn("who", F.lit("x"))
    other = batch(spark, ("a", [2])).withColumn("who", F.lit(None).cast("string"))
    store.replace_by_file(mine.union(other), path, TRANSACTIONS_RAW, who)
    store.replace_by_file(mine.withColumn("amount", F.lit(5)), path, TRANSACTIONS_RAW, who)
    got = store.read_loads(spark, path, TRANSACTIONS_RAW, who)
    assert sorted((r.who or "", float(r.amount)) for r in got.collect()) == [("", 2), ("x", 5)]
    store.replace_by_file(other.withColumn("amount", F.lit(6)), path, TRANSACTIONS_RAW, who)
    got = store.read_loads(spark, path, TRANSACTIONS_RAW, who)
    assert sorted((r.who or "", float(r.amount)) for r in got.collect()) == [("", 6), ("x", 5)]


def test_compaction_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_by_file(batch(spark, ("a", [1]), ("b", [2])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("c", [3]), (None, [0])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("d", [4])), path, TRANSACTIONS_RAW)
    store.replace_by_file(batch(spark, ("a", [5]), ("c", [6])), path, TRANSACTIONS_RAW)
    def seen():
        return sorted((r.source_file or "", float(r.amount)) for r in store.read_loads(spark, path, TRANSACTIONS_RAW).collect())
    want = [("", 0), ("a", 5), ("b", 2), ("c", 6), ("d", 4)]
    assert seen() == want and store.vacuum_loads(spark, path) == []
    assert store.compact_loads(spark, path, TRANSACTIONS_RAW) == [0, 1]
    assert seen() == want
    assert store.vacuum_loads(spark, path) == [0]  # load 1 keeps a row without a file name
    assert seen() == want and store.compact_loads(spark, path, TRANSACTIONS_RAW) == [1]
    assert seen() == want
    store.replace_by_file(batch(spark, ("e", [8])), path, TRANSACTIONS_RAW)
    assert seen() == [*want, ("e", 8)]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    root, schema = str(tmp_path), spark.range(1).schema
    assert store.published(spark, root) == {} and store.read_published(spark, root, "x", schema).count() == 0
    store.publish(spark, root, {n: store.write_full(spark.range(2), f"{root}/{n}") for n in "xy"})
    old = store.read_published(spark, root, "x", schema)
    store.write_full(spark.range(5), f"{root}/x")  # a refresh that broke off before the second table
    assert [store.read_published(spark, root, n, schema).count() for n in "xy"] == [2, 2]
    store.publish(spark, root, {n: store.write_full(spark.range(3), f"{root}/{n}") for n in "xy"})
    assert [store.read_published(spark, root, n, schema).count() for n in "xy"] == [3, 3] and old.count() == 2


def test_deleting_writes_one_small_file(spark, tmp_path):
    path, schema = str(tmp_path / "t"), spark.range(1).schema
    assert store.read_live(spark, path, schema, ["id"]).count() == 0
    store.delete_rows(spark.range(1), path, ["id"])  # nothing there to delete from
    store.append_rows(spark.range(100), path)
    before = stamps(tmp_path / "t")
    store.delete_rows(spark.range(3).union(spark.range(2)), path, ["id"])
    after = stamps(tmp_path / "t")
    assert {f: after[f] for f in before} == before
    assert len([f for f in set(after) - set(before) if f.endswith(".parquet")]) == 1
    store.delete_rows(spark.range(3, 5), path, ["id"])
    store.append_rows(spark.range(100, 101), path)
    assert sorted(r.id for r in store.read_live(spark, path, schema, ["id"]).collect()) == list(range(5, 101))
    store.compact_table(spark, path, schema, ["id"])
    assert sorted(r.id for r in store.read_live(spark, path, schema, ["id"]).collect()) == list(range(5, 101))
    assert store.read_table(spark, path).count() == 96


def test_older_loads_lack_a_column(spark, tmp_path):
    path = str(tmp_path / "t")
    older = T.StructType([f for f in TRANSACTIONS_RAW if f.name != "account"])
    store.replace_by_file(batch(spark, ("a", [1])), path, older)
    newer = batch(spark, ("b", [2])).withColumn("account", F.lit("Visa"))
    store.replace_by_file(newer, path, TRANSACTIONS_RAW)
    got = store.read_loads(spark, path, TRANSACTIONS_RAW).select("source_file", "account")
    assert sorted(rows(got)) == [("a", None), ("b", "Visa")]


def test_full_refresh_keeps_the_version_being_read(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_full(spark.range(3), path)
    old = store.read_table(spark, path)
    store.write_full(old.withColumn("x", F.col("id") % 2), path, ["x"])
    assert old.count() == 3 and store.read_table(spark, path).columns == ["id", "x"]
    (tmp_path / "t" / "v7").mkdir()  # a refresh that broke off
    assert store.latest_version(spark, path).endswith("/v1")
    assert store.write_full(spark.range(1), path).endswith("/v8")
    assert store.read_table(spark, path).count() == 1


def test_partitions_written_by_the_tasks_that_hold_the_rows(spark, tmp_path):
    table = spark.range(0, 60, 1, 3).selectExpr("id", "id % 2 AS x")
    store.write_full(table, str(tmp_path / "t"), ["x"], False)
    assert [len(list((tmp_path / "t" / "v0" / f"x={x}").glob("*.parquet"))) for x in (0, 1)] == [3, 3]
    assert sorted(store.read_table(spark, str(tmp_path / "t")).toPandas()["id"]) == list(range(60))


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "no"))
    assert store.read_table(spark, str(tmp_path / "no"), TRANSACTIONS_RAW).count() == 0


def test_append_insert_delete_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_rows(spark.range(3), path)
    assert store.read_table(spark, path).count() == 3
    store.append_rows(store.insert_missing(store.read_table(spark, path), spark.range(5), ["id"]), path)
    table = store.read_table(spark, path)
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in store.delete_by_key(table, spark.range(2), ["id"]).collect()) == [2, 3, 4]
    assert [r.id for r in store.scan(table, "id > 0", [F.desc("id")], 2).collect()] == [4, 3]
    assert store.scan(table).count() == 5


def registry_of(spark, *accounts):
    df = spark.createDataFrame(list(accounts), "account_id string, name string, account_type string")
    return conform(df, ACCOUNT_DEFINITIONS)


def test_seeds_are_active_and_never_overwrite(spark):
    known = registry_of(spark, ("a", "Mine", "cash"))
    seeds = spark.createDataFrame([("a", "Other", "hsa"), ("b", "New", "savings")],
                                  "account_id string, name string, account_type string")
    got = registry.seed_accounts(known, seeds).select("account_id", "name", "is_active")
    assert rows(got) == [("b", "New", True)]


@pytest.mark.parametrize("name, wanted", [
    ("My Bank", "acct_my_bank"), ("A-B & C's", "acct_ab__cs"),
    ("abcdefghijklmnopqrstuvwxyz", "acct_abcdefghijklmnopqrst"), ("Über 9", "acct_über_9"),
    ("a.b.c.d.e.f.g.h.i.j.k.l", "acct_abcdefghij")])
def test_account_id(spark, name, wanted):
    df = spark.createDataFrame([(name,)], "x string")
    assert rows(df.select(registry.account_id("x"))) == [(wanted,)]


def test_new_accounts(spark):
    known = registry_of(spark, ("acct_old", "Old", "cash"))
    asked = spark.createDataFrame([("Old", "cash"), ("New", "hsa"), ("  ", "cash"), ("new", "cash")],
                                  "name string, account_type string")
    got = registry.new_accounts(known, asked)
    assert sorted(rows(got.select("account_id", "name", "account_type", "is_active"))) == [
        ("acct_new", "New", "hsa", True), ("acct_new-2", "new", "cash", True), ("acct_old-2", "Old", "cash", True)]
    bad = spark.createDataFrame([("X", "boat"), ("  ", "cash"), ("Y", None)], "name string, account_type string")
    assert registry.new_accounts(known, bad).count() == 0
    assert sorted(rows(registry.refused_accounts(bad).select("name", "reason"))) == [
        ("  ", "blank name"), ("X", "unknown account type"), ("Y", "unknown account type")]


def test_new_accounts_keep_every_request(spark):
    """Names that share their first twenty characters, and households that share a name."""
    known = registry_of(spark).withColumn("household_id", F.lit("h1"))
    asked = spark.createDataFrame(
        [("h1", "Retirement savings account one", "hsa"), ("h1", "Retirement savings account two", "hsa"),
         ("h1", "Checking", "cash"), ("h2", "Checking", "cash")],
        "household_id string, name string, account_type string")
    got = registry.new_accounts(known, asked, keys=["household_id"])
    assert sorted(rows(got.select("household_id", "account_id", "name"))) == [
        ("h1", "acct_checking", "Checking"), ("h1", "acct_retirement_savings_a", "Retirement savings account one"),
        ("h1", "acct_retirement_savings_a-2", "Retirement savings account two"), ("h2", "acct_checking", "Checking")]


def test_append_after_an_aborted_refresh(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}/v0")
    (tmp_path / "t" / "v0" / "_SUCCESS").unlink()
    store.append_rows(spark.range(10, 12), path)
    assert sorted(rows(store.read_table(spark, path))) == [(10,), (11,)]
    store.append_rows(spark.range(12, 13), path)
    assert sorted(rows(store.read_table(spark, path))) == [(10,), (11,), (12,)]


def test_new_snapshots(spark):
    entered = spark.createDataFrame(
        [("a", day("2024-01-01"), dec(5)), ("b", day("2024-01-01"), dec(0)), ("c", day("2024-01-01"), dec(-1))],
        "account_id string, snapshot_date date, balance decimal(14,2)")
    got = registry.new_snapshots(entered).collect()
    assert [r.account_id for r in got] == ["a"]
    assert len(got[0].snapshot_id) == 36 and isinstance(got[0].entered_at, dt.datetime)
    assert {r.account_id for r in registry.new_snapshots(entered, allow_zero=True).collect()} == {"a", "b"}
    assert registry.new_snapshots(entered).columns == BALANCE_SNAPSHOTS.fieldNames()


def test_files_of_a_load_are_counted_by_many_tasks(spark, tmp_path):
    """The manifest of very many files is no single task's work."""
    batch = spark.range(2000).select(F.col("id").cast("string").alias("source_file"), F.lit("x").alias("note"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        store.replace_by_file(batch, f"{tmp_path}/t", TRANSACTIONS_RAW)
    assert len(spark.read.parquet(f"{tmp_path}/t/{store.MANIFEST}/{store.LOAD}=0").inputFiles()) > 1
    loads = store.manifest(spark, f"{tmp_path}/t")
    assert loads.count() == 2000 and loads.where("rows = 1 AND is_current").count() == 2000
