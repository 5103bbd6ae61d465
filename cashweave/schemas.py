"""Table schemas, column lists and value domains, declared once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

STR, DATE, TS = T.StringType(), T.DateType(), T.TimestampType()
BOOL, INT, LONG = T.BooleanType(), T.IntegerType(), T.LongType()
MONEY, BALANCE = T.DecimalType(12, 2), T.DecimalType(14, 2)
HOURS, RATE = T.DecimalType(8, 2), T.DecimalType(10, 4)
PAYLOAD = T.MapType(STR, STR)


def _struct(*fields) -> T.StructType:
    """``(name, type)`` pairs, or ``(name, type, nullable)`` triples."""
    return T.StructType([T.StructField(*f) for f in fields])


# --- fixed values: column headers and labels as they appear in the input files ---

CSV_COLUMNS_OLD = ["Group", "Item", "Type", "Date", "Merchant", "Amount", "Note"]
CSV_COLUMNS_NEW = ["Group", "Item", "Type", "Date", "Merchant", "Account", "Amount", "Note"]

PAYSLIP_INFORMATION = "Payslip Information"

SECTION_OF_MARKER = {
    "Current and YTD Totals": "totals",
    "Earnings": "earnings",
    "Employee Taxes": "employee_taxes",
    "Pre Tax Deductions": "pre_tax_deductions",
    "Post Tax Deductions": "post_tax_deductions",
    "Employer Paid Benefits": "employer_paid_benefits",
    "Taxable Wages": "taxable_wages",
    "Withholding": "withholding",
    "Payment Information": "payment_information",
}

TOTALS_METRICS = {
    "Hours Worked": "hours_worked",
    "Gross Pay": "gross_pay",
    "Pre Tax Deductions": "pre_tax_deductions",
    "Employee Taxes": "employee_taxes",
    "Post Tax Deductions": "post_tax_deductions",
    "Net Pay": "net_pay",
}

PRETAX_SAVINGS = ("401(k) Pre-tax", "Health Savings Account-employee (HHSAEE)")
POSTTAX_SAVINGS = ("401(k) Roth",)
ROTH_ACCOUNT_TEXT = "roth ira"

LIQUID_TYPES = ("checking", "savings", "cash")
RETIREMENT_TYPES = ("retirement", "hsa")
INVESTMENT_TYPES = ("investment",)
LIABILITY_TYPES = ("liability",)
ACCOUNT_TYPES = LIQUID_TYPES + RETIREMENT_TYPES + INVESTMENT_TYPES + LIABILITY_TYPES

MERCHANT_CITY_SUFFIXES = ("Tulsa", "Norman", "Oklahoma City", "Oklahoma Cityok")
MERCHANT_STATE_SUFFIX = "OK"

# --- end of fixed values ---

CHECK_KEYS = ["employee_id", "pay_period_begin", "pay_period_end",
              "check_date", "check_number", "source_file"]

TRANSACTIONS_RAW = _struct(
    ("category_group", STR), ("category_item", STR), ("transaction_type", STR),
    ("transaction_date", DATE), ("merchant", STR), ("account", STR),
    ("amount", MONEY), ("note", STR), ("source_file", STR), ("ingest_ts", TS))

PAYSLIP_GRIDS = _struct(("source_file", STR), ("grid", T.ArrayType(T.ArrayType(STR))))

PAYROLL_LINES = _struct(
    ("employee_id", STR), ("pay_period_begin", DATE), ("pay_period_end", DATE),
    ("check_date", DATE), ("check_number", STR), ("section", STR), ("description", STR),
    ("amount", MONEY), ("ytd", BALANCE), ("hours", HOURS), ("rate", RATE), ("dates", STR),
    ("account_name", STR), ("account_number", STR), ("raw_payload", PAYLOAD),
    ("row_no", INT), ("source_file", STR), ("ingest_ts", TS))

ACCOUNT_DEFINITIONS = _struct(
    ("account_id", STR, False), ("name", STR, False), ("account_type", STR, False),
    ("institution", STR), ("is_active", BOOL), ("display_order", INT),
    ("created_at", TS), ("notes", STR))

BALANCE_SNAPSHOTS = _struct(
    ("snapshot_id", STR, False), ("account_id", STR, False), ("snapshot_date", DATE, False),
    ("balance", BALANCE, False), ("note", STR), ("entered_at", TS))

REJECTS = _struct(("source_file", STR), ("item", STR), ("reason", STR), ("ingest_ts", TS))

LOAD_REPORT = _struct(("source_file", STR), ("account", STR), ("rows", LONG), ("ingest_ts", TS))

TRANSACTIONS = _struct(
    ("transaction_key", STR), ("transaction_date", DATE), ("year", INT), ("month", INT),
    ("year_month", STR), ("week_of_year", INT), ("day_of_week", STR), ("day_of_month", INT),
    ("category_group", STR), ("category_item", STR), ("transaction_type", STR),
    ("flow_category", STR), ("direction", STR), ("is_transfer", BOOL),
    ("is_paycheck_deposit", BOOL), ("merchant_raw", STR), ("merchant_clean", STR),
    ("amount", MONEY), ("amount_abs", MONEY), ("note", STR), ("source_file", STR),
    ("ingest_ts", TS), ("account", STR))


def conform(df: DataFrame, schema: T.StructType, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto ``schema`` by name, adding typed NULLs for absent columns.

    Columns declared NOT NULL are checked while the rows flow through: a NULL there raises,
    as an insert into the declared table would. ``extra`` columns are carried in front.
    """
    have = set(df.columns)
    out = [F.col(c) for c in extra if c not in schema.names]
    for f in schema.fields:
        col = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if not f.nullable:
            col = F.when(col.isNull(), F.raise_error(F.lit(f"NULL in required column {f.name}"))
                         .cast(f.dataType)).otherwise(col)
        out.append(col.alias(f.name))
    return df.select(*out)


def keyed(schema: T.StructType, keys) -> T.StructType:
    """``schema`` with the entity keys of the stored tables in front, as text."""
    return T.StructType([*(T.StructField(k, STR) for k in keys if k not in schema.names), *schema.fields])


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
