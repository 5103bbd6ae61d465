from .dates import in_months, month_of, month_ranges, rows_in_months
from .money import (OTHER_WHITE_SPACE, account_bucket, bucket_key, parse_money, recon_status, signed_balance,
                    strip, strip_ends)
from .transactions import (date_parts, direction, flow_category, is_paycheck_deposit,
                           is_transfer, merchant_clean, transaction_key)

__all__ = [
    "OTHER_WHITE_SPACE", "account_bucket", "bucket_key", "date_parts", "direction", "flow_category", "in_months",
    "is_paycheck_deposit", "is_transfer", "merchant_clean", "month_of", "month_ranges",
    "parse_money", "recon_status", "rows_in_months", "signed_balance", "strip", "strip_ends", "transaction_key",
]
