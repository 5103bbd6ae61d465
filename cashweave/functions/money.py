"""Money text, account buckets and reconciliation status."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..schemas import INVESTMENT_TYPES, LIABILITY_TYPES, LIQUID_TYPES, MONEY, RETIREMENT_TYPES

# The labels of the account buckets and of the reconciliation outcomes.
LIQUID = "Liquid"
RETIREMENT = "Retirement/Tax-Advantaged"
INVESTMENT = "Investment"
LIABILITY = "Liability"
OTHER = "Other"
MATCH = "MATCH"
MINOR = "Minor variance"
INVESTIGATE = "INVESTIGATE"
MISSING = "MISSING"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character that counts as white space; the last one is the ideographic space.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
OTHER_WHITE_SPACE = "[" + "".join(rf"\u{ord(c):04x}" for c in WHITE_SPACE if c != " ") + "]"


def strip(c: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def strip_ends(c: Column) -> Column:
    """As :func:`strip`, for text that rarely has white space around it: only where an end is no visible ASCII character is
    the list of white space searched, which costs several times as much as looking at both ends."""
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))
    visible = (first > 32) & (first < 127) & (last > 32) & (last < 127)
    return F.when(visible, c).otherwise(strip(c))


def parse_money(c: Column | str, dtype: T.DecimalType = MONEY) -> Column:
    """``$1,234.56`` and ``(12.00)`` to a decimal; blank or unreadable text to NULL."""
    bare = F.translate(strip(c), "$,", "")
    in_brackets = bare.startswith("(") & bare.endswith(")")
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    return F.when(in_brackets, F.concat(F.lit("-"), inner)).otherwise(bare).try_cast(dtype)


def account_bucket(account_type: Column | str) -> Column:
    t = _col(account_type)
    return (F.when(t.isin(*LIQUID_TYPES), LIQUID)
            .when(t.isin(*RETIREMENT_TYPES), RETIREMENT)
            .when(t.isin(*INVESTMENT_TYPES), INVESTMENT)
            .when(t.isin(*LIABILITY_TYPES), LIABILITY)
            .otherwise(OTHER))


def signed_balance(account_type: Column | str, balance: Column | str) -> Column:
    b = _col(balance)
    return F.when(_col(account_type).isin(*LIABILITY_TYPES), -b).otherwise(b)


def bucket_key(prefix: Column | str, description: Column | str) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lower(F.replace(_col(description), F.lit(" "), F.lit("_"))))


def recon_status(deposits: Column | str, income: Column | str, match: float = 1,
                 minor: float = 50, missing_label: str = MISSING) -> Column:
    """Both bounds are exclusive: a gap of exactly ``match`` is already minor."""
    gap = F.abs(_col(deposits) - _col(income))
    return (F.when(_col(income).isNull(), missing_label)
            .when(gap < match, MATCH)
            .when(gap < minor, MINOR)
            .otherwise(INVESTIGATE))
