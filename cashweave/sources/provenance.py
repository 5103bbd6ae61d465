"""Where a row came from and when it was loaded."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def decode_path(uri: Column | str) -> Column:
    """A file path as the file system spells it: Spark reports it percent-encoded, ``+`` bare."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def base_name(uri: Column | str) -> Column:
    return F.regexp_extract(decode_path(uri), r"[^/]+$", 0)


def path_keys(uri: Column | str, keys: Sequence[str]) -> list[Column]:
    """Entity keys that a file's folders name, as in ``household_id=7/budget.csv``; NULL where no folder does."""
    path = decode_path(uri)
    return [F.nullif(F.regexp_extract(path, rf"(?:^|/){re.escape(k)}=([^/]+)/", 1), F.lit("")).alias(k) for k in keys]


def with_provenance(df: DataFrame, uri: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the ``keys`` of its files in front, ``source_file`` (name without folder) and ``ingest_ts``."""
    own = [c for c in df.columns if c not in (*keys, "source_file", "ingest_ts")]
    return df.select(*path_keys(uri, keys), *own, base_name(uri).alias("source_file"),
                     F.current_timestamp().alias("ingest_ts"))
