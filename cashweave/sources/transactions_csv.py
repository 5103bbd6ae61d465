"""Budget-transaction CSVs in two layouts, aligned by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import parse_money
from ..schemas import CSV_COLUMNS_NEW, CSV_COLUMNS_OLD, MONEY, STR, TRANSACTIONS_RAW
from ..session import scratch_path, staged
from .provenance import base_name, decode_path, path_keys

DATE_PATTERN = "MM/dd/yyyy"
RAW = T.StructType([T.StructField(c, STR) for c in CSV_COLUMNS_NEW]
                   + [T.StructField("source_file", STR), T.StructField("ingest_ts", T.TimestampType(), False)])
_BITS = 4  # bits per column position in a header code; eight columns need four


def _names(line: Column) -> Column:
    return F.transform(F.split(F.lower(line), ","),
                       lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def _header_code(line: Column) -> Column:
    """The number of columns and the position of each known one, packed into a bigint.

    A number keeps the per-file aggregate below a hash aggregate, which text would not: it would
    be sorted. Lines that cannot be a header are not taken apart.
    """
    names = _names(line)
    code = F.size(names).cast("long") * F.lit(1 << _BITS * len(CSV_COLUMNS_NEW))
    for i, name in enumerate(CSV_COLUMNS_NEW):
        code += F.array_position(names, name.lower()) * F.lit(1 << _BITS * i)
    small = F.size(names) <= len(CSV_COLUMNS_NEW)
    lowered = F.lower(line)
    return F.when(lowered.contains("group") & lowered.contains("amount"),
                  F.when(small, code).otherwise(0)).otherwise(0)


def csv_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Every line with content of the CSV files in ``path``, with ``recursive`` in all folders below as well: ``file``,
    ``block`` (where its split begins), ``at`` (its place among the lines of the split) and ``value``."""
    return (spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower()).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value")
            .where(F.col("value").rlike(r"[^\x00-\x20]")))


def layouts(lines: DataFrame) -> DataFrame:
    """One row per file: ``file``, ``first`` (the place of its first line), ``code``, ``header`` and ``layout``.

    ``layout`` is ``old`` (seven columns), ``new`` (eight, with Account) or ``unknown`` with a NULL header. Lines of
    later splits are dropped, and the rest is reduced to two numbers per file before the shuffle.
    """
    first = (lines.where("block = 0").select("file", "at", _header_code(F.col("value")).alias("code"))
             .groupBy("file").agg(F.min("at").alias("first"), F.min_by("code", "at").alias("code")))
    width = F.shiftright("code", _BITS * len(CSV_COLUMNS_NEW))
    ordered = F.array_sort(F.filter(
        F.array(*[F.struct(_place(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(CSV_COLUMNS_NEW)]),
        lambda c: c["at"] > 0))
    header = F.transform(ordered, lambda c: c["name"])
    known = F.array_sort(header)
    layout = (F.when((width == len(CSV_COLUMNS_OLD))
                     & (known == F.array(*map(F.lit, sorted(CSV_COLUMNS_OLD)))), "old")
              .when((width == len(CSV_COLUMNS_NEW))
                    & (known == F.array(*map(F.lit, sorted(CSV_COLUMNS_NEW)))), "new")
              .otherwise("unknown"))
    return first.select("file", "first", "code", F.when(layout != "unknown", header).alias("header"),
                        layout.alias("layout"))


def _place(i: int) -> Column:
    """The position, from one, of the i-th known column in a header code; zero if the header lacks it."""
    return F.shiftright("code", _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def classify_csv_layout(spark: SparkSession, path: str) -> DataFrame:
    """One row per CSV file: its path, its header as an ordered list of known columns, its layout."""
    return layouts(csv_lines(spark, path)).select(decode_path("file").alias("file"), "header", "layout")


def aligned(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of all files of a known layout, as text columns by name, with provenance; ``keys`` come in front.

    Each file's first line is joined to its other lines as a header: a row is taken apart by position, once, and
    each column finds its own. However many headers there are, this is one plan, and nothing reaches the driver.
    Headers are staged with what a file's path says, one row per file: paths are taken apart once a file, not once a
    row, and as Spark knows the size of what is staged, the rows are moved only for a batch of very many files.
    """
    spark = lines.sparkSession
    found = layouts(lines).where("layout <> 'unknown'").select(
        "file", "first", "code", base_name("file").alias("source_file"),
        *(c.alias(f"__key{i}") for i, c in enumerate(path_keys("file", keys))))
    found = staged(found, scratch_path(spark, "csv-layouts"))
    cells = ", ".join(f"c{i} string" for i in range(len(CSV_COLUMNS_NEW)))
    of_file = [*(F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)), "source_file"]
    rows = (lines.select("file", "at", "value").join(found, "file").where("at <> first")
            .select("code", *of_file, F.from_csv("value", F.lit(cells), {"quote": '"', "escape": '"'}).alias("cells")))
    rows = rows.select("code", *keys, "source_file",
                       F.array(*[f"cells.c{i}" for i in range(len(CSV_COLUMNS_NEW))]).alias("cells"))
    return rows.select(*keys, *[F.get("cells", _place(i) - 1).alias(n) for i, n in enumerate(CSV_COLUMNS_NEW)],
                       "source_file", F.current_timestamp().alias("ingest_ts"))


def read_transactions_csv(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """All files of a known layout below ``path``, as text columns with provenance.

    The files are scanned once, into the shared scratch folder, since header and rows both come from their lines.
    Files of an unknown layout are left out; :func:`classify_csv_layout` lists them. ``keys`` are read from the files'
    folders (``household_id=7/budget.csv``), at any depth below ``path``.
    """
    return aligned(staged(csv_lines(spark, path, bool(keys)), scratch_path(spark, "csv-lines")), keys)


def _date(c: str = "Date") -> Column:
    return F.try_to_timestamp(c, F.lit(DATE_PATTERN)).cast("date")


def clean_transactions(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Typed bronze transactions. A date or amount that cannot be read becomes NULL."""
    return raw.select(
        *keys,
        F.col("Group").alias("category_group"), F.col("Item").alias("category_item"),
        F.col("Type").alias("transaction_type"), _date().alias("transaction_date"),
        F.col("Merchant").alias("merchant"), F.col("Account").alias("account"),
        parse_money("Amount", MONEY).alias("amount"), F.col("Note").alias("note"),
        "source_file", "ingest_ts")


def unreadable() -> Column:
    """What of a row's date and amount was given but could not be read; an empty text if nothing."""
    def what(c: str, parsed: Column) -> Column:
        return F.when((F.trim(c) != "") & parsed.isNull(), F.lit(f"unreadable {c.lower()}"))

    return F.concat_ws(", ", what("Date", _date()), what("Amount", parse_money("Amount", MONEY)))


def rejected_transactions(raw: DataFrame) -> DataFrame:
    """The rows whose date or amount was given but could not be read, with the reason."""
    return raw.withColumn("reason", unreadable()).where("reason <> ''")


__all__ = ["RAW", "TRANSACTIONS_RAW", "aligned", "classify_csv_layout", "clean_transactions", "csv_lines", "layouts",
           "read_transactions_csv", "rejected_transactions", "unreadable"]
