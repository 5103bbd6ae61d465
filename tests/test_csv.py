import re

import pytest
from pyspark.sql import functions as F

from cashweave.sources import transactions_csv as tc
from .conftest import day, dec, plan, rows

OLD = "Group,Item,Type,Date,Merchant,Amount,Note\n"
NEW = "Group,Item,Type,Date,Merchant,Account,Amount,Note\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "old.csv").write_text(OLD + 'Food,Out,expense,01/02/2024,"Joe ""Big"", Inc",-5.00,\n')
    (tmp_path / "new.csv").write_text(NEW + 'Food,Out,expense,01/03/2024,Ann,Visa,"$1,234.56",x\n')
    (tmp_path / "turned.csv").write_text(
        "Amount,Account,Date,Type,Item,Group,Note,Merchant\n(7.00),Visa,01/04/2024,fund,In,Car,n,Bo\n")
    (tmp_path / "six.csv").write_text("Group,Item,Type,Date,Merchant,Amount\na,b,c,d,e,f\n")
    (tmp_path / "names.csv").write_text("A,B,C,D,E,F,G\n1,2,3,4,5,6,7\n")
    (tmp_path / "blank.csv").write_text("")
    (tmp_path / "other.txt").write_text(OLD + "x,y,z,01/01/2024,m,1,\n")
    return tmp_path


def test_layouts(spark, folder):
    got = {r.file.rsplit("/", 1)[1]: (r.layout, r.header) for r in
           tc.classify_csv_layout(spark, str(folder)).collect()}
    assert got == {
        "old.csv": ("old", OLD.strip().split(",")), "new.csv": ("new", NEW.strip().split(",")),
        "turned.csv": ("new", ["Amount", "Account", "Date", "Type", "Item", "Group", "Note", "Merchant"]),
        "six.csv": ("unknown", None), "names.csv": ("unknown", None)}


def test_header_must_be_the_first_line(spark, tmp_path):
    (tmp_path / "late.csv").write_text("exported today\n" + OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    (tmp_path / "quoted.csv").write_text('"Group" , "Item",type,DATE,Merchant,"Amount",Note\n')
    got = {r.file.rsplit("/", 1)[1]: r.layout for r in tc.classify_csv_layout(spark, str(tmp_path)).collect()}
    assert got == {"late.csv": "unknown", "quoted.csv": "old"}


def test_read_aligns_layouts_by_name(spark, folder):
    raw = tc.read_transactions_csv(spark, str(folder))
    clean = tc.clean_transactions(raw).orderBy("transaction_date")
    assert rows(clean.drop("ingest_ts")) == [
        ("Food", "Out", "expense", day("2024-01-02"), 'Joe "Big", Inc', None, dec(-5), None, "old.csv"),
        ("Food", "Out", "expense", day("2024-01-03"), "Ann", "Visa", dec(1234.56), "x", "new.csv"),
        ("Car", "In", "fund", day("2024-01-04"), "Bo", "Visa", dec(-7), "n", "turned.csv")]
    assert clean.where(F.col("ingest_ts").isNull()).count() == 0


def test_only_old_layout_still_has_account(spark, tmp_path):
    (tmp_path / "old.csv").write_text(OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    assert tc.clean_transactions(tc.read_transactions_csv(spark, str(tmp_path))).first().account is None


def test_no_files_give_a_typed_empty_frame(spark, tmp_path):
    raw = tc.read_transactions_csv(spark, str(tmp_path))
    assert raw.schema == tc.RAW and raw.count() == 0
    assert tc.clean_transactions(raw).count() == 0


@pytest.mark.parametrize("name", ["a b.csv", "a+b.csv", "a%b.csv", "x'y.csv", "a%20b.csv", "p{q}[r].csv"])
def test_source_file_is_the_name_as_stored(spark, tmp_path, name):
    (tmp_path / name).write_text(OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    raw = tc.read_transactions_csv(spark, str(tmp_path))
    assert [r.source_file for r in raw.collect()] == [name]


def test_one_plan_for_all_headers_and_no_second_scan(spark, folder):
    """Headers and rows come from one scan of the text; however many layouts there are, it is one join."""
    text = plan(tc.read_transactions_csv(spark, str(folder)))
    assert "FileScan text" not in text and "FileScan csv" not in text and text.count("FileScan parquet") == 2
    assert "Union" not in text and len(re.findall(r"Join", text)) == 1 and "Python" not in text
    assert plan(tc.csv_lines(spark, str(folder))).count("FileScan text") == 1


def test_headers_reach_the_later_splits_of_a_file(spark, tmp_path):
    """A file of many splits: only the first holds the header, whose columns are in another order."""
    lines = [f"n{i},{i}.00,Food,Out,expense,M{i},01/02/2024\n" for i in range(4000)]
    (tmp_path / "long.csv").write_text("Note,Amount,Group,Item,Type,Merchant,Date\n" + "".join(lines))
    (tmp_path / "other.csv").write_text(OLD + "Car,Fuel,expense,01/03/2024,Gas,-1.00,x\n")
    (tmp_path / "gap.csv").write_text("\n  \n" + OLD + "\nCar,Fuel,expense,01/03/2024,Gas,-2.00,\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert tc.csv_lines(spark, str(tmp_path)).select("block").distinct().count() > 10
        got = tc.clean_transactions(tc.read_transactions_csv(spark, str(tmp_path)))
        rows = {(r.source_file, r.category_group, r.merchant, float(r.amount), r.note) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {("long.csv", "Food", f"M{i}", float(i), f"n{i}") for i in range(4000)} | {
        ("other.csv", "Car", "Gas", -1.0, "x"), ("gap.csv", "Car", "Gas", -2.0, None)}


def test_keys_come_from_the_folders(spark, tmp_path):
    for who in ("h 1", "h+2"):
        (tmp_path / f"who={who}").mkdir()
        (tmp_path / f"who={who}" / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    (tmp_path / "loose.csv").write_text(OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    got = tc.read_transactions_csv(spark, str(tmp_path), ["who"])
    assert got.columns[0] == "who"
    assert {(r.who, r.source_file) for r in got.collect()} == {("h 1", "jan.csv"), ("h+2", "jan.csv"), (None, "loose.csv")}


def test_rejects(spark, tmp_path):
    (tmp_path / "f.csv").write_text(OLD + "a,b,c,2024-01-02,m,1.00,\na,b,c,01/02/2024,m,oops,\n"
                                    "a,b,c,nope,m,oops,\na,b,c,,m,,\na,b,c,01/02/2024,m,1.00,\n")
    raw = tc.read_transactions_csv(spark, str(tmp_path))
    reasons = sorted(r.reason for r in tc.rejected_transactions(raw).collect())
    assert reasons == ["unreadable amount", "unreadable date", "unreadable date, unreadable amount"]
    assert tc.clean_transactions(raw).count() == 5


def test_paths_are_taken_apart_per_file_and_rows_are_not_moved(spark, tmp_path):
    """Names and keys come with a file's header, so neither text functions on paths nor an exchange is in the rows' plan."""
    (tmp_path / "who=h1").mkdir()
    (tmp_path / "who=h1" / "jan.csv").write_text(OLD + "Food,Out,expense,01/02/2024,J,-5.00,\n")
    raw = tc.read_transactions_csv(spark, str(tmp_path), ["who"])
    text = plan(raw)
    assert "BroadcastHashJoin" in text and "Exchange hash" not in text
    assert "regexp_extract" not in text and "url_decode" not in text
    assert [(r.who, r.source_file, r.Merchant) for r in raw.collect()] == [("h1", "jan.csv", "J")]
