"""Month filters as date ranges, so that Parquet statistics can prune on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F


def month_of(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_ranges(months: Iterable[str]) -> list[tuple[dt.date, dt.date]]:
    """``yyyy-MM`` texts to half-open date ranges, adjacent months merged."""
    def following(d: dt.date) -> dt.date:
        return dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)

    out: list[tuple[dt.date, dt.date]] = []
    for first in sorted({dt.date.fromisoformat(f"{m}-01") for m in months}):
        if out and out[-1][1] == first:
            out[-1] = (out[-1][0], following(first))
        else:
            out.append((first, following(first)))
    return out


def in_months(date: Column | str, months: Iterable[str] | None) -> Column:
    """``date`` lies in one of ``months``; ``None`` restricts nothing, an empty list all."""
    if months is None:
        return F.lit(True)
    date = F.col(date) if isinstance(date, str) else date
    ranges = [(date >= F.lit(a)) & (date < F.lit(b)) for a, b in month_ranges(months)]
    return reduce(or_, ranges, F.lit(False)) if ranges else F.lit(False)


def rows_in_months(df: DataFrame, date: str, months: Iterable[str] | None) -> Column:
    """:func:`in_months` for the rows of ``df``; if it has ``year_month``, by which stored transactions are partitioned,
    that is restricted too, so that other months' files are not even listed."""
    inside = in_months(date, months := None if months is None else list(months))
    return inside & F.col("year_month").isin(months) if months and "year_month" in df.columns else inside
