import pytest
from pyspark.sql import functions as F

from cashweave.operators import payroll as pay, payslips as ps
from cashweave.schemas import PAYROLL_LINES, PAYSLIP_GRIDS
from cashweave.sources import workbooks as wb
from fixtures import derive
from fixtures.derive import payslip_grids, workbook_bytes
from .conftest import day, dec, plan, rows

GRID = [
    ["Payslip Information"],
    ["Employee ID", "Pay Period Begin", "Pay Period End", "Check Date", "Check Number"],
    ["7", "12/18/2023", "12/31/2023", "01/05/2024", "99"],
    [],
    ["Current and YTD Totals"],
    ["Balance Period", "Gross Pay", "Net Pay"],
    ["Current", "$1,100.00", "800.00"],
    ["YTD", "1,100.00", "800.00"],
    ["Employee Taxes"],
    ["Description", "Amount", "YTD"],
    ["OASDI", "68.20", "68.20"],
    [],
    ["Adjustment", "(5.00)"],
]


def grids(spark, *data):
    padded = [(f"f{i}.xlsx", [row + [""] * (5 - len(row)) for row in grid]) for i, grid in enumerate(data)]
    return spark.createDataFrame(padded, PAYSLIP_GRIDS)


def lines(spark, grid):
    df = ps.payroll_lines(grids(spark, grid))
    return {(r.section, r.description): r for r in df.collect()}


def test_documented_grid(spark):
    got = lines(spark, GRID)
    assert {k: (r.amount, r.ytd) for k, r in got.items()} == {
        ("totals", "Gross Pay"): (dec(1100), dec(1100)), ("totals", "Net Pay"): (dec(800), dec(800)),
        ("employee_taxes", "OASDI"): (dec(68.2), dec(68.2)),
        ("employee_taxes", "Adjustment"): (dec(-5), None)}
    r = got["employee_taxes", "OASDI"]
    assert (r.employee_id, r.check_number, r.check_date, r.pay_period_begin, r.source_file) == (
        "7", "99", day("2024-01-05"), day("2023-12-18"), "f0.xlsx")
    assert r.raw_payload == {"Description": "OASDI", "Amount": "68.20", "YTD": "68.20"}


def test_result_has_the_declared_schema(spark):
    got = ps.payroll_lines(grids(spark, GRID)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in PAYROLL_LINES]


def test_ragged_rows_and_null_cells(spark):
    grid = [["Payslip Information"], ["Employee ID", "Check Number"], ["7"], [None], [],
            ["Withholding", None], ["Description", "", None, "Amount"], ["Federal", "x", None, "3", "4"], ["State"]]
    df = ps.payroll_lines(spark.createDataFrame([("f", grid)], PAYSLIP_GRIDS))
    got = rows(df.select("description", "amount", "employee_id", "check_number", "row_no"))
    assert got == [("Federal", dec(3), "7", None, 7), ("State", None, "7", None, 8)]


def test_empty_sections_and_sheets(spark):
    assert lines(spark, [["Earnings"], ["Withholding"], ["Description", "Amount"], ["F", "1"]]).keys() == {
        ("withholding", "F")}
    assert lines(spark, []) == {} and lines(spark, [["nothing"], ["here"]]) == {}


def test_no_information_block_gives_null_meta(spark):
    df = ps.payroll_lines(grids(spark, GRID[4:]))
    assert df.count() == 4
    assert df.where("employee_id IS NULL AND check_date IS NULL AND check_number IS NULL").count() == 4
    assert rows(ps.payslip_meta(grids(spark, GRID[4:]))) == [("f0.xlsx", None, None, None, None, None)]


def test_information_block_after_a_section_ends_it(spark):
    grid = [["Withholding"], ["Description", "Amount"], ["Federal", "1.00"],
            ["Payslip Information"], ["Employee ID"], ["8"]]
    got = lines(spark, grid)
    assert list(got) == [("withholding", "Federal")] and got["withholding", "Federal"].employee_id == "8"


def test_marker_on_the_last_row(spark):
    assert set(lines(spark, GRID + [["Earnings"]])) == set(lines(spark, GRID))


def test_last_totals_row_and_last_duplicate_header_count(spark):
    grid = [["Current and YTD Totals"], ["Balance Period", "Net Pay", "", "Net Pay"],
            ["Current", "1", "9", "2"], ["YTD", "5", "", "6"], ["Current", "3", "9", "4"], ["Other", "7"]]
    got = lines(spark, grid)
    assert [(k, r.amount, r.ytd) for k, r in got.items()] == [(("totals", "Net Pay"), dec(4), dec(6))]


def test_description_and_amount_fall_back(spark):
    grid = [["Payment Information"],
            ["Bank", "Account Name", "Account Number", "Amount in Pay Group Currency"],
            ["Bank A", "O'Hara IRA", "****1", "10.00"],
            ["Earnings"], ["Code", "Hours Worked", "Rate", "Amount", "Dates"],
            ["", "80", "12.3456", "", "x"], ["E1", "abc", "", "1", ""]]
    df = ps.payroll_lines(grids(spark, grid))
    got = {(r.section, r.description): r for r in df.collect()}
    a = got["payment_information", "Bank A"]
    assert (a.amount, a.account_name, a.account_number) == (dec(10), "O'Hara IRA", "****1")
    blank, e1 = got["earnings", ""], got["earnings", "E1"]
    assert (blank.hours, str(blank.rate), blank.amount, blank.dates) == (dec(80), "12.3456", None, "x")
    assert (e1.hours, e1.amount) == (None, dec(1))


def test_two_totals_blocks_do_not_mix(spark):
    block = [["Current and YTD Totals"], ["Balance Period", "Net Pay"]]
    df = ps.payroll_lines(grids(spark, block + [["Current", "1"]] + block + [["YTD", "2"]]))
    assert sorted((r.amount, r.ytd) for r in df.collect() if r.amount) == [(dec(1), None)]
    assert [(r.amount, r.ytd) for r in df.collect() if r.ytd] == [(None, dec(2))]


def test_workbooks_round_trip(spark, tmp_path):
    (tmp_path / "a b.xlsx").write_bytes(workbook_bytes(GRID))
    (tmp_path / "c+d.XLSX").write_bytes(workbook_bytes(GRID))
    (tmp_path / "note.txt").write_text("not a workbook")
    read = wb.read_payslip_grids(spark, str(tmp_path))
    assert sum(len(r.grid) for r in read.collect()) == 2 * len(GRID)
    got = ps.payroll_lines(read)
    assert {r.source_file for r in got.collect()} == {"a b.xlsx", "c+d.XLSX"}
    totals = pay.paycheck_totals(got)
    assert rows(totals.select("gross_pay", "net_pay", "gross_pay_ytd", "hours_worked")) == [
        (dec(1100), dec(800), dec(1100), None)] * 2


def test_workbook_cell_types():
    import io
    import zipfile
    main = wb.MAIN[1:-1]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                   '<sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/>'
                   "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/>'
                   '<Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si>'
                   "<si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData>'
                   '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
                   '<row r="4"><c r="A4"><v>7</v></c><c r="B4"><v>68.2</v></c><c r="C4" t="b"><v>1</v></c>'
                   '<c r="D4" t="e"><v>#N/A</v></c><c r="E4" t="str"><v>f</v></c><c r="AA4"><v>-1</v></c></row>'
                   "</sheetData></worksheet>")
    got = wb.sheet_rows(out.getvalue())
    assert len(got) == 4 and {len(r) for r in got} == {27}
    assert got[0] == [""] * 27 and got[1][:3] == ["plain", "", "rich"] and got[2] == [""] * 27
    assert got[3][:5] == ["7", "68.2", "True", "", "f"] and got[3][26] == "-1"


def test_a_broken_workbook_stops_no_other(spark, tmp_path):
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "good.xlsx").write_bytes(workbook_bytes(GRID))
    got = {r["source_file"]: r for r in wb.read_payslip_grids(spark, str(tmp_path)).collect()}
    assert got["good.xlsx"]["error"] is None and len(got["good.xlsx"]["grid"]) == len(GRID)
    assert got["broken.xlsx"]["grid"] is None and "not a readable workbook" in got["broken.xlsx"]["error"]


def test_rejected_payslips(spark):
    grid = [["Payslip Information"], ["Employee ID", "Check Date", "Pay Period End"], ["e", "soon", ""],
            ["Earnings"], ["Description", "Amount", "Hours"], ["Regular", "1,000.00", "much"], ["Bonus", "", "x"]]
    got = sorted(rows(ps.rejected_payslips(grids(spark, grid)).select("item", "reason")))
    assert got == [("much", "unreadable hours"), ("soon", "unreadable check_date"), ("x", "unreadable hours")]
    assert ps.rejected_payslips(grids(spark, GRID)).count() == 0


def test_payments_equal_the_fields_of_the_payload(spark):
    """The stored columns say the same as looking the fields up in the raw payload."""
    grid = [["Payment Information"], ["Bank", "Account Name", "Account Number", "Amount"],
            ["Bank A", "Checking", "****1", "10.00"]]
    df = ps.payroll_lines(grids(spark, grid))
    direct = rows(pay.payments(df).select("bank", "account_name", "account_number_masked"))
    assert direct == rows(df.select("description", F.col("raw_payload")["Account Name"],
                                    F.col("raw_payload")["Account Number"]))


def test_parts_that_name_the_first_sheet_are_parsed_once_for_files_that_share_them():
    wb._first_sheet_part.cache_clear()
    rows = [["Payslip Information"], [], ["a & b", "", " c "]]
    books = [workbook_bytes(rows + [[str(n)]]) for n in range(5)]
    assert [wb.sheet_rows(b)[2:] for b in books] == [[["a & b", "", " c "], [str(n), "", ""]] for n in range(5)]
    assert wb._first_sheet_part.cache_info().misses == 1


def test_cells_are_looked_up_behind_the_explode(spark):
    """Not in a lambda for every line, so that a payload nobody asks for is not made."""
    found = ps.payroll_lines(grids(spark, GRID))
    assert "map_from_arrays" in plan(found) and "map_from_arrays" not in plan(found.drop("raw_payload"))


def test_grids_keep_their_tasks(spark, sf_dir):
    """Few bytes, but costly rows: not put together to fewer tasks by their size."""
    assert payslip_grids(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("others", ["", "\u00e9", "\t\u3000"])
def test_all_white_space_is_stripped(spark, others):
    """Each kind of it, in grids with blanks alone, with other letters and with other white space; missing cells are blank."""
    for space in (" ", "  ", "\t", "\n", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000"):
        grid = [["Payslip Information", None], [f"{space}Employee ID", None], [f"7{space}", others], [f"{space}Earnings{space}", None],
                [f"Description{space}", f"{space}Amount", "Dates"], [f"{space}Re gular{space}", f"{space}$5.00{space}", f"a{space}b"]]
        df = spark.createDataFrame([("f.xlsx", grid)], PAYSLIP_GRIDS)
        got = [(r.employee_id, r.section, r.description, r.amount, r.dates) for r in ps.payroll_lines(df).collect()]
        assert got == [("7", "earnings", "Re gular", dec(5), f"a{space}b")], repr(space)


def _book(sheet, method=0, **parts):
    import io
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{wb.MAIN[1:-1]}" xmlns:r="{wb.REL_ID[1:-3]}"><sheets>'
                   '<sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        for name, text in parts.items():
            z.writestr(f"xl/{name}.xml", text)
        z.writestr("xl/worksheets/a.xml", sheet)
    return out.getvalue()


def _sheet(rows_, head="", tail=""):
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{wb.MAIN[1:-1]}">{head}<sheetData>{rows_}</sheetData>{tail}</worksheet>'


PLAIN_ROWS = ('<row r="2" spans="1:3"><c r="A2" s="1" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>a &lt;&amp;amp; b</t></is></c></row>'
              '<row><c><v>7</v></c><c t="b"><v>1</v></c><c r="AB3"><v>1.50</v></c><c r="AC3" s="2"/><c t="e"><v>#N/A</v></c></row>'
              '<row r="5"><c r="A5" t="inlineStr"><is><t xml:space="preserve"> é\n</t></is></c><c r="B5" t="str"><v>x</v></c><c r="A5"></c></row>')


@pytest.mark.parametrize("method", [0, 8])
def test_plain_sheets_are_read_without_building_their_elements(method, monkeypatch):
    strings = f'<sst xmlns="{wb.MAIN[1:-1]}"><si><t>none</t></si><si><t>one</t></si></sst>'
    books = [_book(_sheet(PLAIN_ROWS), method, sharedStrings=strings), workbook_bytes(GRID)]
    elements = wb._element_rows(_sheet(PLAIN_ROWS).encode(), ["none", "one"])
    monkeypatch.setattr(wb, "_element_rows", lambda *_: pytest.fail("elements were built"))
    got = wb.sheet_rows(books[0])
    assert got == [r + [""] * (30 - len(r)) for r in elements]
    assert got[1][:3] == ["one", "", "a <&amp; b"] and got[2][:2] + got[2][27:] == ["7", "True", "1.5", "", ""]
    assert got[3] == [""] * 30 and got[4][:3] == [" é\n", "x", ""]
    assert wb.sheet_rows(books[1]) == [r + [""] * (5 - len(r)) for r in GRID]


@pytest.mark.parametrize("change", [
    ("<v>7</v>", "<f>A1</f><v>7</v>"), ("<t>a ", "<!-- n --><t>a "), ("<is><t>a", "<is><r><t>rich</t></r><t>a"), ("&lt;", "&#955;"),
    ("&lt;", "<![CDATA[<]]>"), ("<row>", '<row ht="5">'), ("<row>", '<row r="3"/><row>'), ("</row><row>", "</row>\n<row>"),
    ("<sheetData>", "<x/><!-- <sheetData></sheetData> --><sheetData>"), ("a &lt;", "a\r\n"), ("</v></c></row>", "</v></c>"),
    ("&lt;", "&none;"), ("&lt;", "\x01"), ("</sheetData>", "</sheetData><sheetData><row><c><v>5</v></c></row></sheetData>"),
    ('encoding="UTF-8"', 'encoding="latin-1"'), ("</worksheet>", "</worksheets>"), ("<sheetData>", "<y><sheetData/></y><sheetData>"),
    ("<row>", "<row><row>"), ("<v>7</v>", "<v>seven</v>"), ("<v>7</v>", "<v></v>"), ("<row>", "</row>"), ('s="1" ', 's="1" s="1" ')])
def test_other_sheets_are_read_as_their_elements_say(change):
    """Formulas, comments, rich text, references, other layouts, and sheets that are not well formed."""
    sheet = _sheet(PLAIN_ROWS).replace(*change, 1)
    assert sheet != _sheet(PLAIN_ROWS)

    def read(how):
        try:
            return how()
        except Exception as err:
            return type(err), str(err)

    ours = read(lambda: [[c for c in r] for r in wb.sheet_rows(_book(sheet, sharedStrings=f'<sst xmlns="{wb.MAIN[1:-1]}"><si/><si><t>one</t></si></sst>'))])
    theirs = read(lambda: wb._element_rows(sheet.encode(), ["", "one"]))
    if isinstance(theirs, list):
        theirs = [r + [""] * (max(map(len, theirs)) - len(r)) for r in theirs]
    assert ours == theirs


def test_parts_of_a_zip_are_those_that_zipfile_reads():
    """Every byte of a workbook changed in turn: what is read, or that it cannot be read, is the same."""
    import io
    import zipfile

    def read(how):
        try:
            return how()
        except Exception as err:
            return type(err)

    def by_zipfile(content):
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            return wb._sheet_and_strings(book.namelist(), book.read)

    for method in (0, 8):
        good = _book(_sheet("<row><c><v>1</v></c></row>"), method)
        assert wb._plain_parts(good).keys() == {"xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/a.xml"}
        assert wb._plain_parts(b"x" + good) is None and wb._plain_parts(good + b"x") is None and wb._plain_parts(b"") is None
        for at in range(len(good)):
            for bits in (1, 128, 255):
                bad = good[:at] + bytes([good[at] ^ bits]) + good[at + 1:]
                assert read(lambda: wb._unpacked(bad)) == read(lambda: by_zipfile(bad)), (at, bits)


def test_batches_of_workbooks_are_packed_as_single_ones(spark, sf_dir):
    import io
    import zipfile
    made = derive.workbooks(spark, sf_dir).join(payslip_grids(spark, sf_dir), "source_file").limit(50).collect()
    assert made and all(wb.sheet_rows(r["content"]) == wb.sheet_rows(workbook_bytes(r["grid"])) for r in made)
    odd = [[["a&b<c>", "", None, "x"], [], None], [], [["", ""], [" "]], None]
    import pyarrow as pa
    packed = derive._sheets(pa.array(odd, pa.list_(pa.list_(pa.string())))).to_pylist()
    for grid, sheet in zip(odd, packed):
        with zipfile.ZipFile(io.BytesIO(workbook_bytes([r or [] for r in grid or []]))) as book:
            assert sheet == book.read(derive.SHEET)
