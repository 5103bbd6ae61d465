"""Payslip grids to typed payroll lines, in Spark expressions.

A grid is ``(source_file, grid)``: all rows of a sheet in order, blank rows included, every row an
array of text cells. A workbook is unpacked inside one task anyway, so its grid arrives as one row
and is taken apart with array functions: from file to typed lines nothing is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import OTHER_WHITE_SPACE, parse_money, strip_ends
from ..schemas import (BALANCE, HOURS, MONEY, PAYROLL_LINES, PAYSLIP_INFORMATION, RATE,
                       SECTION_OF_MARKER, conform)

DATE_PATTERN = "MM/dd/yyyy"
# The headers of the information block and of the data rows.
META = {
    "employee_id": "Employee ID",
    "pay_period_begin": "Pay Period Begin",
    "pay_period_end": "Pay Period End",
    "check_date": "Check Date",
    "check_number": "Check Number",
}
FIELDS = ("Description", "Bank", "Balance Period", "Amount", "Amount in Pay Group Currency", "YTD",
          "Hours", "Hours Worked", "Rate", "Dates", "Account Name", "Account Number")


def _last_at(backwards: Column, name: Column) -> Column:
    """Index of the last header of that name, given the headers in reverse; NULL if there is none."""
    from_end = F.nullif(F.array_position(backwards, name), F.lit(0))
    return (F.size(backwards) - from_end).cast("int")


def _blocks(grids: DataFrame) -> DataFrame:
    """Strip all cells and find the blocks: label, first row and the row after the last.

    A marker in the first cell opens a block, which ends where the next one opens. An information
    block is one of them, so that it closes the section before it.
    """
    text = F.array_join(F.flatten("grid"), "")
    # Told once for all cells of a grid, so that with blanks alone each cell costs a plain trim.
    only_blanks = ~(text.rlike("[^ -~]") & text.rlike(OTHER_WHITE_SPACE))

    def stripped(how) -> Column:
        return F.transform("grid", lambda row: F.transform(row, lambda c: how(F.coalesce(c, F.lit("")))))

    tidy = F.when(only_blanks, stripped(F.trim)).otherwise(stripped(strip_ends))
    marks = F.filter(
        F.transform("grid", lambda row, i: F.struct(F.get(row, F.lit(0)).alias("label"), i.alias("at"))),
        lambda m: m["label"].isin(*SECTION_OF_MARKER, PAYSLIP_INFORMATION))
    blocks = F.transform("marks", lambda m, i: F.struct(
        m["label"].alias("label"), m["at"].alias("start"),
        F.coalesce(F.get("marks", i + 1)["at"], F.size("grid")).alias("end")))
    info = F.get(F.filter("marks", lambda m: m["label"] == PAYSLIP_INFORMATION), F.lit(0))
    return (grids.select("source_file", tidy.alias("grid")).withColumn("marks", marks)
            .withColumns({"blocks": blocks, "info_at": info["at"]}))


DATES = ("pay_period_begin", "pay_period_end", "check_date")
AMOUNTS = {"amount": MONEY, "ytd": BALANCE, "hours": HOURS, "rate": RATE}


def _date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DATE_PATTERN)).cast("date")


def _check(typed: bool = True) -> Column:
    """The check, from the header and value rows of the first information block; dates as text if not ``typed``."""
    headers, values = (F.get("grid", F.col("info_at") + n) for n in (1, 2))
    backwards = F.reverse(headers)

    def read(name: str, header: str) -> Column:
        text = F.get(values, _last_at(backwards, F.lit(header)))
        return (_date(text) if typed and name in DATES else text).alias(name)

    return F.struct(*[read(n, h) for n, h in META.items()])


def payslip_meta(grids: DataFrame) -> DataFrame:
    """Who was paid, for what period and when: one row per file, NULL for what is not there."""
    return _blocks(grids).select("source_file", _check().alias("check")).select("source_file", "check.*")


def payslip_sections(grids: DataFrame) -> DataFrame:
    """One row per section of a file: its check, headers, and data rows with their row numbers.

    The row after a marker holds the headers. Blank rows belong to nothing.
    """
    section_of = F.create_map(*[F.lit(x) for pair in SECTION_OF_MARKER.items() for x in pair])

    def section(b: Column) -> Column:
        body = F.slice("grid", b["start"] + 3, F.greatest(b["end"] - b["start"] - 2, F.lit(0)))
        numbered = F.transform(body, lambda row, i: F.struct(
            (b["start"] + 2 + i).alias("row_no"), row.alias("values")))
        return F.struct(section_of[b["label"]].alias("section"), b["start"].alias("start"),
                        F.get("grid", b["start"] + 1).alias("headers"),
                        F.filter(numbered, lambda r: F.array_join(r["values"], "") != "").alias("rows"))

    found = F.transform(F.filter("blocks", lambda b: b["label"] != PAYSLIP_INFORMATION), section)
    return (_blocks(grids).withColumn("check", _check())
            .select("source_file", "check.*", F.explode(found).alias("s"))
            .select("source_file", *META, "s.*"))


def _names() -> Column:
    """The headers that are not blank, each once."""
    return F.array_distinct(F.filter("headers", lambda h: h != ""))


def _places() -> Column:
    """The position of each of the :func:`_names`, given the headers in reverse."""
    return F.transform(_names(), lambda n: _last_at(F.col("backwards"), n))


def _totals_rows() -> Column:
    """The totals block turned round, in the shape of data rows: per metric its name, amount and year-to-date value.

    The last ``Current`` row gives the amounts and the last ``YTD`` row the year-to-date values.
    A metric's place among the headers serves as its row number.
    """
    pairs = F.zip_with(_names(), _places(), lambda n, at: F.struct(n.alias("name"), at.alias("at")))
    metrics = F.filter(pairs, lambda m: m["name"] != "Balance Period")
    return F.transform(metrics, lambda m, i: F.struct(
        i.alias("row_no"), F.array(m["name"], F.get("current", m["at"]), F.get("to_date", m["at"])).alias("values")))


def _items(sections: DataFrame) -> DataFrame:
    """Every section to its lines, amounts still as text.

    Where each field stands is worked out once per section, from its headers; a repeated header
    counts by its last column and a column without one drops out. The cells of a line are looked up
    behind the explode, in generated code, which lambdas over arrays do not have.
    """
    backwards, is_totals = F.col("backwards"), F.col("section") == "totals"
    at, cells = ({name: f"{prefix}_{n}" for n, name in enumerate(FIELDS)} for prefix in ("at", "cell"))
    of_metric = {"Description": 0, "Amount": 1, "YTD": 2}
    items = F.when(is_totals, _totals_rows()).otherwise(F.when(F.array_join("headers", "") != "", F.col("rows")))

    def last_row(label: str) -> Column:
        hits = F.filter("rows", lambda r: F.get(r["values"], F.col("at_period")) == label)
        return F.when(is_totals, F.try_element_at(hits, F.lit(-1))["values"])

    def place(name: str) -> Column:
        return F.when(is_totals, F.lit(of_metric.get(name)).cast("int")).otherwise(_last_at(backwards, F.lit(name)))

    def text(*options: str) -> Column:
        """The first of these cells that is not blank; blank if all of them are."""
        out = F.col(cells[options[-1]])
        for name in reversed(options[:-1]):
            out = F.when(F.col(cells[name]) != "", F.col(cells[name])).otherwise(out)
        return out

    values = F.col("item.values")
    payload = F.map_from_arrays("names", F.transform("at", lambda i: F.get("item.values", i)))
    return (sections
            .withColumns({"backwards": F.reverse("headers"),
                          "first_name": F.get(F.filter("headers", lambda h: h != ""), F.lit(0))})
            # The names and places of all columns serve the payload of a line: not worked out where that is not wanted.
            .withColumns({"names": _names(), "at": _places(), "at_first": _last_at(backwards, F.col("first_name")),
                          "at_period": _last_at(backwards, F.lit("Balance Period")),
                          **{at[name]: place(name) for name in FIELDS}})
            .withColumns({"current": last_row("Current"), "to_date": last_row("YTD")})
            # Not made a column first: Spark would work it out twice more, to filter sections without lines.
            .select("source_file", "section", *META, "names", "at", "at_first", *at.values(), F.explode(items).alias("item"))
            # One step for the cells and one for what is read from them: generated code of moderate size.
            .select("source_file", "section", *META, "item.row_no", F.get(values, F.col("at_first")).alias("first"),
                    *[F.get(values, F.col(at[name])).alias(cells[name]) for name in FIELDS],
                    F.when(~is_totals, payload).alias("raw_payload"))
            .withColumn("described", text("Description", "Bank", "Balance Period"))
            .select("source_file", "section", *META, "row_no",
                    F.when(F.col("described") != "", F.col("described")).otherwise(F.col("first")).alias("description"),
                    text("Amount", "Amount in Pay Group Currency").alias("amount"), text("YTD").alias("ytd"),
                    text("Hours", "Hours Worked").alias("hours"), text("Rate").alias("rate"), text("Dates").alias("dates"),
                    text("Account Name").alias("account_name"), text("Account Number").alias("account_number"),
                    "raw_payload"))


def _expand(sections: DataFrame) -> DataFrame:
    """Every section to its payroll lines."""
    return _items(sections).select(
        "source_file", "section", *META, "row_no", "description",
        *[parse_money(c, kind).alias(c) for c, kind in AMOUNTS.items()],
        "dates", "account_name", "account_number", "raw_payload")


def payslip_totals(sections: DataFrame) -> DataFrame:
    """The totals block: one row per metric."""
    return _expand(sections.where(F.col("section") == "totals"))


def payslip_lines(sections: DataFrame) -> DataFrame:
    """One row per line of every other section."""
    return _expand(sections.where(F.col("section") != "totals"))


def payroll_lines(grids: DataFrame) -> DataFrame:
    """The complete bronze frame of a batch of grids, each read once."""
    return conform(_expand(payslip_sections(grids)).withColumn("ingest_ts", F.current_timestamp()),
                   PAYROLL_LINES)


def rejected_payslips(grids: DataFrame) -> DataFrame:
    """What was given but could not be read: ``source_file``, ``item`` (the text) and ``reason``, one row per date of a
    check and per amount of a line."""
    def unreadable(text: Column, parsed: Column, name: str) -> Column:
        bad = (F.coalesce(text, F.lit("")) != "") & parsed.isNull()
        return F.when(bad, F.struct(text.alias("item"), F.lit(f"unreadable {name}").alias("reason")))

    def listed(rows: DataFrame, found: list[Column]) -> DataFrame:
        return rows.select("source_file", F.inline(F.array_compact(F.array(*found))))

    checks = _blocks(grids).select("source_file", _check(typed=False).alias("check"))
    dates = [unreadable(F.col(f"check.{c}"), _date(F.col(f"check.{c}")), c) for c in DATES]
    amounts = [unreadable(F.col(c), parse_money(c, kind), c) for c, kind in AMOUNTS.items()]
    return listed(checks, dates).unionByName(listed(_items(payslip_sections(grids)), amounts))
