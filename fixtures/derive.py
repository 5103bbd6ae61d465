"""Finance-shaped inputs derived from the given tables, as in FIXTURES.md. No table is cut."""

from __future__ import annotations

import io
import struct
import sys
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.schemas import BALANCE, HOURS, MONEY, RATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One payslip line per entry: section, description, amount, and the checks that have it
# (order key modulo ``m`` equals ``r``).
LINES = [
    ("totals", "Hours Worked", 80, 1, 0), ("totals", "Gross Pay", 0, 1, 0),
    ("totals", "Pre Tax Deductions", 100, 1, 0), ("totals", "Employee Taxes", 200, 1, 0),
    ("totals", "Post Tax Deductions", 50, 1, 0), ("totals", "Net Pay", 0, 1, 0),
    ("earnings", "Regular", 0, 1, 0),
    ("employee_taxes", "OASDI", 120, 1, 0), ("employee_taxes", "Medicare", 80, 1, 0),
    ("pre_tax_deductions", "401(k) Pre-tax", 60, 1, 0),
    ("pre_tax_deductions", "Dental", 40, 2, 0),
    ("pre_tax_deductions", "Health Savings Account-employee (HHSAEE)", 40, 2, 1),
    ("post_tax_deductions", "401(k) Roth", 50, 3, 0), ("post_tax_deductions", "Parking", 50, 3, 1),
    ("employer_paid_benefits", "401(k) Match", 75, 5, 2),
    ("payment_information", "Bank A", 0, 1, 0), ("payment_information", "Bank B", 100, 2, 0),
    ("taxable_wages", "Federal Wages", 900, 1, 0), ("withholding", "Federal Withholding", 30, 4, 1),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, by: str, evenly: bool = False) -> DataFrame:
    """Rows of a given table, dealt out by a column.

    Each table is a single file of one row group here, which one task reads. ``evenly`` keeps all partitions, for rows that are
    small but costly, which AQE would put together by their size to little more tasks than there are cores. What is moved
    is best moved as days and decimals: a timestamp or a double is eight bytes of which hardly any repeats.
    """
    if evenly:
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    return rows.repartition(by)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def checks(spark: SparkSession, sf_dir: str, evenly: bool = False) -> DataFrame:
    """One pay check per order."""
    orders = dealt(table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("check_date"), F.col("o_orderkey").alias("k"),
        F.col("o_totalprice").cast(MONEY).alias("gross_pay")), "k", evenly)
    return orders.select(
        _text("o_custkey").alias("employee_id"), "check_date", _text("k").alias("check_number"), "k",
        F.concat(F.lit("payslip_"), (F.col("k") % 100).cast("string"), F.lit(".xlsx")).alias("source_file"),
        "gross_pay", (F.col("gross_pay") - 350).cast(MONEY).alias("net_pay"))


def payroll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every check; some checks lack a section, which exercises the outer joins."""
    k = F.col("k")
    entries = F.array(*[
        F.struct(F.lit(n).alias("row_no"), F.lit(section).alias("section"),
                 F.lit(text).alias("description"), F.lit(amount).alias("amt"),
                 F.lit(m).alias("m"), F.lit(r).alias("r"))
        for n, (section, text, amount, m, r) in enumerate(LINES)])
    text, net, gross = F.col("description"), F.col("net_pay"), F.col("gross_pay")
    odd = F.when(k % 2 == 0, 100).otherwise(0)
    amount = (F.when(text.isin("Gross Pay", "Regular"), gross).when(text == "Net Pay", net)
              .when(text == "Bank A", net - odd).otherwise(F.col("amt")))
    ytd = (F.when(text == "Gross Pay", gross * 2).when(text == "Net Pay", net * 2)
           .otherwise(F.col("amt") * 2))
    earning = F.col("section") == "earnings"
    begin, end = F.date_sub("check_date", 14), F.date_sub("check_date", 1)
    return (checks(spark, sf_dir)
            .select("*", F.inline(entries)).where("k % m = r")
            .select("employee_id", begin.alias("pay_period_begin"), end.alias("pay_period_end"),
                    "check_date", "check_number", "section", "description",
                    amount.cast(MONEY).alias("amount"), ytd.cast(BALANCE).alias("ytd"),
                    F.when(earning, F.lit(80).cast(HOURS)).alias("hours"),
                    F.when(earning, F.lit("12.5").cast(RATE)).alias("rate"),
                    F.when(earning, F.concat_ws(" - ", begin, end)).alias("dates"),
                    F.when(text == "Bank A", "Checking").when(text == "Bank B", "My Roth IRA")
                    .alias("account_name"),
                    F.when(F.col("section") == "payment_information",
                           F.concat(F.lit("****"), (k % 10000).cast("string")))
                    .alias("account_number"),
                    "row_no", "source_file"))


def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped transactions: one per line item, and a pay deposit for most checks.

    Line items are moved twice, to their orders and to their parts, as the few numbers they need.
    """
    number, price = F.col("l_linenumber"), F.col("price")
    null = F.lit(None).cast("string")
    fund = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    # The day and, in the six lowest bits, whether there is one, the line numbers that mean something, and two flags.
    code = (F.coalesce(day, F.lit(0)).cast("long") * 64 + F.when(day.isNull(), 32).otherwise(0)
            + F.when(number.isin(1, 2, 3, 4, 5, 7), number).otherwise(0) * 4
            + F.when(fund, 2).otherwise(0) + F.when(F.col("l_discount") != 0, 1).otherwise(0))
    line = F.shiftright("code", 2).bitwiseAND(7)
    day = F.when(F.col("code").bitwiseAND(32) == 0, F.date_from_unix_date(F.shiftright("code", 6).cast("int")))
    items = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("price"), code.alias("code")),
        "l_orderkey")
    spending = (
        items
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(_text("o_custkey").alias("entity_id"), day.alias("transaction_date"),
                F.col("p_type").alias("category_group"), F.col("p_brand").alias("category_item"),
                F.when(F.col("code").bitwiseAND(2) != 0, "fund")
                .when(line == 7, "adjustment").otherwise("expense").alias("transaction_type"),
                F.concat(F.lit("Supplier#"), _text("l_suppkey"),
                         F.when(line == 1, "   Tulsa OK").when(line == 2, " Norman")
                         .when(line == 3, " **** X12").when(line == 4, "  Main  St")
                         .otherwise("")).alias("merchant"),
                F.when(F.year(day) >= 1999,
                       F.concat(F.lit("acct_"), (F.col("l_suppkey") % 3).cast("string")))
                .alias("account"),
                F.when(line == 5, price).otherwise(-price).cast(MONEY).alias("amount"),
                F.when(F.col("code").bitwiseAND(1) != 0, "n").alias("note"),
                F.concat(F.lit("budget_"), F.year(day).cast("string"), F.lit(".csv"))
                .alias("source_file")))
    k = F.col("k")
    paid = (F.col("net_pay") - F.when(k % 2 == 0, 100).otherwise(0)
            + F.when(k % 4 == 1, 20).when(k % 4 == 2, 500).otherwise(0))
    deposits = (
        checks(spark, sf_dir).where("k % 4 <> 3")
        .select(F.col("employee_id").alias("entity_id"),
                F.date_add("check_date", (k % 5).cast("int")).alias("transaction_date"),
                F.lit("Income").alias("category_group"),
                F.concat(F.lit("Paycheck "), (1 + k % 2).cast("string")).alias("category_item"),
                F.lit("income").alias("transaction_type"), F.lit("Employer").alias("merchant"),
                null.alias("account"), paid.cast(MONEY).alias("amount"), null.alias("note"),
                F.concat(F.lit("budget_"), F.year("check_date").cast("string"), F.lit(".csv"))
                .alias("source_file")))
    return spending.unionByName(deposits)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    types = ["checking", "savings", "retirement", "hsa", "investment", "cash", "liability", "vehicle"]
    return (table(spark, sf_dir, "events").select("user_id").distinct()
            .select((user % 10).alias("household_id"), user.alias("account_id"),
                    F.concat(F.lit("Account "), _text("user_id")).alias("name"),
                    F.get(F.array(*map(F.lit, types)), (user % 8).cast("int")).alias("account_type"),
                    F.concat(F.lit("Institution "), (user % 3).cast("string")).alias("institution"),
                    F.when(user % 11 != 0, user % 10 != 0).alias("is_active"),
                    (user % 20).cast("int").alias("display_order")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .select((F.col("user_id") % 10).alias("household_id"),
                    F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("account_id"),
                    F.col("ts").cast("date").alias("snapshot_date"),
                    F.round(F.col("value") * 100).cast(BALANCE).alias("balance"),
                    F.lit(None).cast("string").alias("note"),
                    F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("entered_at")))


def payslip_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payslip grid per check, named after it, with blank rows and money as printed text."""
    k = F.col("k")

    def row(*cells) -> Column:
        cells = [F.lit(c) if isinstance(c, str) else c for c in cells]
        return F.array(*cells, *[F.lit("")] * (5 - len(cells)))

    def money(c) -> Column:
        return F.concat(F.lit("$"), F.format_number(F.lit(c) if isinstance(c, int) else c, 2))

    def us(c: Column) -> Column:
        return F.date_format(c, "MM/dd/yyyy")

    gross, net, day = F.col("gross_pay"), F.col("net_pay"), F.col("check_date")
    rows = [
        row("Payslip Information"),
        row("Employee ID", "Pay Period Begin", "Pay Period End", "Check Date", "Check Number"),
        row(F.col("employee_id"), us(F.date_sub(day, 14)), us(F.date_sub(day, 1)), us(day),
            F.col("check_number")),
        row(),
        row("Current and YTD Totals"),
        row("Balance Period", "Hours Worked", "Gross Pay", "Net Pay"),
        row("Current", "80", money(gross), money(net)),
        row("YTD", "", money(gross * 2), money(net * 2)),
        row(" Earnings "),
        row("Description", "Dates", "Hours", "Rate", "Amount"),
        row("Regular", us(day), "80", "12.5", money(gross)),
        row(),
        row("Employee Taxes"),
        row("Description", "Amount", "YTD", "YTD"),
        row("OASDI", "120.00", "1.00", "240.00"),
        row("Adjustment", "(5.25)"),
        F.when(k % 2 == 0, row("Pre Tax Deductions")),
        F.when(k % 2 == 0, row("Description", "Amount")),
        F.when(k % 2 == 0, row("Dental", "n/a")),
        row("Payment Information"),
        row("Bank", "Account Name", "Account Number", "Amount in Pay Group Currency"),
        row("Bank A", "Checking", "****1", money(net)),
    ]
    grid = F.filter(F.array(*rows), lambda r: r.isNotNull())
    name = F.concat(F.lit("payslip_"), F.col("check_number"), F.lit(".xlsx"))
    return checks(spark, sf_dir, evenly=True).select(name.alias("source_file"), grid.alias("grid"))


MAIN_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = "xl/worksheets/sheet1.xml"
SHEET_ENDS = f'<worksheet xmlns="{MAIN_NS}"><sheetData>', "</sheetData></worksheet>"
CELL_END = "</t></is></c>"


def _cell_start(r: int, c: int) -> str:
    return f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t xml:space="preserve">'


def workbook_bytes(rows: list[list[str]]) -> bytes:
    """A minimal .xlsx; blank cells and blank rows are left out, as spreadsheet programs do."""
    body = []
    for r, row in enumerate(rows, 1):
        cells = "".join(f"{_cell_start(r, c)}{escape(v)}{CELL_END}" for c, v in enumerate(row) if v)
        if cells:
            body.append(f'<row r="{r}">{cells}</row>')
    return _zipped("".join((SHEET_ENDS[0], *body, SHEET_ENDS[1])).encode())


def _zipped(sheet: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN_NS}" xmlns:r="{REL_NS}"><sheets>'
                   '<sheet name="Payslip" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship "
                   'Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr(SHEET, sheet)
    return out.getvalue()


def _sheets(grids: pa.ListArray) -> pa.BinaryArray:
    """The sheet part of :func:`workbook_bytes` for a whole batch of grids."""
    rows = grids.flatten()
    cells = rows.flatten()
    sizes, widths = (np.asarray(pc.fill_null(pc.list_value_length(a), 0), np.int64) for a in (grids, rows))
    grid_ends, row_ends = (np.concatenate(([0], np.cumsum(n))).astype(np.int32) for n in (sizes, widths))
    r = np.arange(len(rows)) - np.repeat(grid_ends[:-1], sizes)
    c = np.arange(len(cells)) - np.repeat(row_ends[:-1], widths)
    most, wide = int(sizes.max(initial=0)), int(widths.max(initial=0))
    starts = pa.array([_cell_start(i + 1, j) for i in range(most) for j in range(wide)], pa.string())
    opens = pa.array([f'<row r="{i + 1}">' for i in range(most)], pa.string())
    text = cells
    for char, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        text = pc.replace_substring(text, char, entity)
    cell = pc.binary_join_element_wise(starts.take(pa.array(np.repeat(r, widths) * wide + c)), text, CELL_END, "")
    cell = pc.if_else(pc.fill_null(pc.not_equal(cells, ""), False), cell, "")
    row = pc.binary_join(pa.ListArray.from_arrays(row_ends, cell), "")
    row = pc.if_else(pc.equal(row, ""), "", pc.binary_join_element_wise(opens.take(pa.array(r)), row, "</row>", ""))
    body = pc.binary_join(pa.ListArray.from_arrays(grid_ends, row), "")
    return pc.binary_join_element_wise(SHEET_ENDS[0], body, SHEET_ENDS[1], "").cast(pa.binary())


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payslip grids as workbook files ``(source_file, content)``. They differ in their sheets only, which come last in
    a file, so that each is the same bytes around its sheet but for the sheet's checksum and size."""
    empty = _zipped(b"")
    with zipfile.ZipFile(io.BytesIO(empty)) as book:
        at, end = book.getinfo(SHEET).header_offset, book.start_dir
    before, after = empty[:end], empty[end:]
    entry = after.rindex(b"PK\1\2")

    def pack(batches):
        head, tail = bytearray(before), bytearray(after)

        def file(sheet: bytes) -> bytes:
            numbers = zlib.crc32(sheet), len(sheet), len(sheet)
            struct.pack_into("<3I", head, at + 14, *numbers)
            struct.pack_into("<3I", tail, entry + 16, *numbers)
            struct.pack_into("<I", tail, len(tail) - 6, end + len(sheet))  # where the directory begins
            return b"".join((head, sheet, tail))

        for batch in batches:
            for part in (batch.slice(n, 1000) for n in range(0, len(batch), 1000)):
                made = pa.array([file(s) for s in _sheets(part.column("grid")).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("source_file"), made], ["source_file", "content"])

    return payslip_grids(spark, sf_dir).mapInArrow(pack, "source_file string, content binary")
