"""Derived columns of a budget transaction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..schemas import MERCHANT_CITY_SUFFIXES, MERCHANT_STATE_SUFFIX
from .dates import month_of


# Masked card text after a merchant's name, and what a pay deposit is filed under.
MASKED_CARD = r"\s+\*+\s*\w*$"
INCOME_GROUP, PAYCHECK_ITEM = "Income", r"^Paycheck \d+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def direction(amount: Column | str = "amount") -> Column:
    a = _col(amount)
    return F.when(a > 0, "inflow").when(a < 0, "outflow").otherwise("zero")


def is_transfer(transaction_type: Column | str = "transaction_type") -> Column:
    return _col(transaction_type).eqNullSafe(F.lit("fund"))


def flow_category(transaction_type: Column | str = "transaction_type") -> Column:
    t = _col(transaction_type)
    return (F.when(t == "fund", "transfer").when(t.isin("income", "expense"), t)
            .otherwise("other"))


def date_parts(date: Column | str = "transaction_date") -> dict[str, Column]:
    """The week is the ISO week while the year is the calendar year."""
    d = _col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "year_month": month_of(d),
        "week_of_year": F.weekofyear(d),
        "day_of_week": F.date_format(d, "EEEE"),
        "day_of_month": F.dayofmonth(d),
    }


def merchant_clean(merchant: Column | str = "merchant",
                   suffixes: Sequence[str] = MERCHANT_CITY_SUFFIXES,
                   state: str = MERCHANT_STATE_SUFFIX) -> Column:
    """Single blanks, no trailing city with optional state, no trailing masked card text."""
    name = F.trim(F.regexp_replace(_col(merchant), r"\s+", " "))
    if suffixes:
        cities = "|".join(re.escape(s) for s in suffixes)
        name = F.regexp_replace(name, rf"\s+(?:{cities})\s*(?:{re.escape(state)})?$", "")
    return F.regexp_replace(name, MASKED_CARD, "")


def is_paycheck_deposit(group: Column | str = "category_group",
                        item: Column | str = "category_item") -> Column:
    hit = (_col(group) == INCOME_GROUP) & _col(item).rlike(PAYCHECK_ITEM)
    return F.coalesce(hit, F.lit(False))


def transaction_key(date="transaction_date", group="category_group", item="category_item",
                    merchant="merchant", amount="amount", source_file="source_file") -> Column:
    """sha-256 over the natural key. NULL parts are skipped, so equal rows share a key."""
    parts = [_col(c).cast("string") for c in (date, group, item, merchant, amount, source_file)]
    return F.sha2(F.concat_ws("||", *parts), 256)
