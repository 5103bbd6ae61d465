"""New accounts and balance snapshots, as rows ready to append."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import strip
from ..schemas import ACCOUNT_DEFINITIONS, ACCOUNT_TYPES, BALANCE_SNAPSHOTS, conform
from .numbering import numbered
from .store import insert_missing

NAME_LENGTH = 20


def account_id(name: Column | str) -> Column:
    """``acct_`` and the first twenty characters of the name, letters, digits and ``_`` only."""
    name = F.col(name) if isinstance(name, str) else name
    plain = F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, NAME_LENGTH)
    return F.concat(F.lit("acct_"), F.regexp_replace(plain, r"[^\p{L}\p{N}_]", ""))


def seed_accounts(registry: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The seeds the registry does not know yet, active unless they say otherwise."""
    active = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in seeds.columns else F.lit(True)
    return insert_missing(registry, conform(seeds.withColumn("is_active", active),
                                            ACCOUNT_DEFINITIONS, keys), [*keys, "account_id"])


def _refusal() -> Column:
    """Why a request is refused; NULL if it is not."""
    return (F.when(F.coalesce(strip("name"), F.lit("")) == "", "blank name")
            .when(~F.coalesce(F.col("account_type").isin(*ACCOUNT_TYPES), F.lit(False)), "unknown account type"))


def new_accounts(registry: DataFrame, requests: DataFrame, keys: Sequence[str] = (),
                 keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """An account for every valid request, with an id of its own within its entity; ``keys`` come first.

    Requests that generate the same id are numbered by name and then by their other columns, after the
    accounts already registered: ``acct_x``, ``acct_x-2``, ... A generated id has no hyphen, so a numbered
    one is never another name's. What is left out is listed by :func:`refused_accounts`. ``keep`` stages what the
    numbering needs, see :func:`.numbering.numbered`.
    """
    keys, number = list(keys), F.regexp_extract("account_id", r"-(\d+)$", 1)
    taken = (registry.select(*keys, F.regexp_replace("account_id", r"-\d+$", "").alias("base"),
                             F.when(number == "", 1).otherwise(number.cast("int")).alias("n"))
             .groupBy(*keys, "base").agg(F.max("n").alias("taken")))
    rows = (requests.where(_refusal().isNull()).withColumn("base", account_id("name"))
            .withColumn("is_active", F.lit(True)))
    others = sorted(c for c in requests.columns if c not in ("name", *keys))
    rows = numbered(rows, [*keys, "base"], ["name", *others], "at", keep)
    same = F.lit(True)
    for c in [*keys, "base"]:
        same = same & rows[c].eqNullSafe(taken[c])
    n = F.col("r.at") + F.coalesce("taken", F.lit(0))
    named = (rows.alias("r").join(taken, same, "left")
             .select(*[F.col(f"r.{c}") for c in rows.columns if c not in ("base", "at")],
                     F.concat(F.col("r.base"), F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")).alias("account_id")))
    return conform(named, ACCOUNT_DEFINITIONS, keys)


def refused_accounts(requests: DataFrame) -> DataFrame:
    """The requests without a name or with a type that does not exist, with the ``reason``."""
    return requests.withColumn("reason", _refusal()).where("reason IS NOT NULL")


def new_snapshots(balances: DataFrame, allow_zero: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Snapshots of the entered balances: positive ones, or also zero, with id and time of entry."""
    wanted = F.col("balance") >= 0 if allow_zero else F.col("balance") > 0
    return conform(balances.where(wanted).withColumn("snapshot_id", F.uuid())
                   .withColumn("entered_at", F.current_timestamp()), BALANCE_SNAPSHOTS, keys)
