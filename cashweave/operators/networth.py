"""Account balances: current, and carried forward through time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import account_bucket, money as M, signed_balance
from ._keys import left_join_per_day, per_entity


def _newest(*more: str):
    """Order of snapshots: a NULL ``entered_at`` is the oldest, ``snapshot_id`` breaks ties."""
    return F.struct(*more, "entered_at", "snapshot_id")


def latest_balances(snapshots: DataFrame, accounts: DataFrame,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Each active account with its newest snapshot; NULL balance where there is none.

    The newest row is an aggregate rather than a row number: it is reduced before the shuffle,
    so an account with very many snapshots is no hot spot.
    """
    latest = (snapshots.groupBy(*keys, "account_id")
              .agg(F.max_by(F.struct("snapshot_date", "balance"), _newest("snapshot_date"))
                   .alias("latest")))
    return (accounts.where("is_active").join(latest, [*keys, "account_id"], "left")
            .select(*keys, "account_id", "name", "account_type", "institution", "display_order",
                    F.col("latest.snapshot_date").alias("as_of_date"),
                    F.col("latest.balance").alias("balance"),
                    account_bucket("account_type").alias("bucket")))


def summarize(current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def total(bucket: str):
        return F.sum(F.when(F.col("bucket") == bucket, F.col("balance")).otherwise(0))

    return (current.groupBy(*keys)
            .agg(F.sum(signed_balance("account_type", "balance")).alias("net_worth"),
                 total(M.LIQUID).alias("liquid_cash"),
                 total(M.RETIREMENT).alias("retirement_total"),
                 total(M.INVESTMENT).alias("investments"),
                 total(M.LIABILITY).alias("liabilities"),
                 F.max("as_of_date").alias("latest_snapshot_date")))


def net_worth_summary(accounts: DataFrame, snapshots: DataFrame,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Accounts of another type count in the net worth but in no part of it."""
    return summarize(latest_balances(snapshots, accounts, keys), keys)


def daily_balances(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last balance per account and day: at most one row per account and calendar day."""
    return (snapshots.groupBy(*keys, "account_id", "snapshot_date")
            .agg(F.max_by("balance", _newest()).alias("balance")))


def as_of_balances(snapshots: DataFrame, accounts: DataFrame,
                   keys: Sequence[str] = ()) -> DataFrame:
    """The balance of each active account carried forward, as validity intervals.

    A balance holds from ``valid_from`` up to, not including, ``valid_to`` (NULL: still holds).
    This says for every date what was known then without a row per date and account.
    """
    days = (daily_balances(snapshots, keys)
            .join(accounts.where("is_active").select(*keys, "account_id", "account_type"),
                  [*keys, "account_id"]))
    by_day = Window.partitionBy(*keys, "account_id").orderBy("snapshot_date")
    return days.select(*keys, "account_id", "account_type",
                       F.col("snapshot_date").alias("valid_from"),
                       F.lead("snapshot_date").over(by_day).alias("valid_to"), "balance")


def net_worth_history(accounts: DataFrame, snapshots: DataFrame,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Net worth and its parts on every date any account has a snapshot.

    Each snapshot changes the carried-forward total by its difference to the account's previous
    one, so the history is a running sum of daily changes: work grows with the snapshots, not
    with dates times accounts. Dates known only from accounts that are inactive or not
    registered still appear; dates before the first balance of an active account do not.
    """
    registered = accounts.where("is_active").select(*keys, "account_id", "account_type")
    days = daily_balances(snapshots, keys).join(registered, [*keys, "account_id"], "left")

    by_day = Window.partitionBy(*keys, "account_id").orderBy("snapshot_date")
    active = F.col("account_type").isNotNull()
    held = F.when(active, F.coalesce("balance", F.lit(0))).otherwise(0)
    present = (active & F.col("balance").isNotNull()).cast("int")
    changes = (days.withColumn("held", held).withColumn("present", present)
               .withColumn("change", F.col("held") - F.lag("held", 1, 0).over(by_day))
               .withColumn("started", F.col("present") - F.lag("present", 1, 0).over(by_day))
               .withColumn("bucket", account_bucket("account_type")))

    def part(bucket: str):
        return F.sum(F.when(F.col("bucket") == bucket, F.col("change")).otherwise(0))

    per_day = (changes.groupBy(*keys, F.col("snapshot_date").alias("as_of_date"))
               .agg(F.sum(signed_balance("account_type", "change")).alias("net_worth"),
                    part(M.LIQUID).alias("liquid"), part(M.RETIREMENT).alias("retirement"),
                    part(M.INVESTMENT).alias("investments"),
                    F.sum("started").alias("started")))

    # At most one row per key and calendar day from here on.
    up_to = per_entity(keys).orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    totals = ["net_worth", "liquid", "retirement", "investments"]
    return (per_day.select(*keys, "as_of_date", *[F.sum(c).over(up_to).alias(c) for c in totals],
                           F.sum("started").over(up_to).alias("accounts"))
            .where("accounts > 0").select(*keys, "as_of_date", *totals))


def _as_known_on(probes: DataFrame, known: DataFrame, by: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """``probes`` with the ``values`` of the newest row of ``known`` on or before ``day``, NULL where there is none.

    ``known`` holds one row per ``by`` and day. Its rows and the days asked for, each once, form one stream per ``by``,
    sorted by day, along which the last row is carried: at most two rows per calendar day, however many probes an
    entity has. The probes then join on equality of the day, without a range join and without being sorted.
    """
    carried = [c for c in by if c != day]
    stream = known.select(*carried, day, F.struct(*values).alias("__known")).unionByName(
        probes.select(*carried, day).where(F.col(day).isNotNull()).distinct(), allowMissingColumns=True)
    along = per_entity(carried).orderBy(day, F.col("__known").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = (stream.withColumn("__last", F.last("__known", ignorenulls=True).over(along))
            .where(F.col("__known").isNull()).select(*carried, day, "__last"))
    return left_join_per_day(probes, seen, carried, day).select(
        *probes.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def balances_as_of(probes: DataFrame, snapshots: DataFrame, keys: Sequence[str] = (), day: str = "as_of_date") -> DataFrame:
    """``probes`` (``keys``, ``account_id``, ``day``) with the account's ``balance`` on that day and the ``snapshot_date`` it
    comes from; NULL before the account's first snapshot, for accounts that have none, and without a day. Repeated
    probes stay; whether an account is active plays no part."""
    by = [*keys, "account_id"]
    days = daily_balances(snapshots, keys).select(*by, "snapshot_date", F.col("snapshot_date").alias(day), "balance")
    return _as_known_on(probes, days, by, day, ["balance", "snapshot_date"])


def net_worth_as_of(probes: DataFrame, accounts: DataFrame, snapshots: DataFrame, keys: Sequence[str] = (),
                    day: str = "as_of_date") -> DataFrame:
    """``probes`` (``keys``, ``day``) with the net worth and its parts as known on that day, by the rules of
    :func:`net_worth_history`; NULL before the first balance of an active account. Repeated probes stay."""
    history = net_worth_history(accounts, snapshots, keys).withColumnRenamed("as_of_date", day)
    return _as_known_on(probes, history, list(keys), day, ["net_worth", "liquid", "retirement", "investments"])


# --- reports ---------------------------------------------------------------------------------


def net_worth_headline(accounts: DataFrame, snapshots: DataFrame,
                       keys: Sequence[str] = ()) -> DataFrame:
    return net_worth_summary(accounts, snapshots, keys)


def current_balances(snapshots: DataFrame, accounts: DataFrame,
                     keys: Sequence[str] = ()) -> DataFrame:
    return (latest_balances(snapshots, accounts, keys).orderBy(*keys, "display_order")
            .select(*keys, "name", "account_type", "institution", "bucket", "balance", "as_of_date"))


def active_accounts(accounts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (accounts.where("is_active").orderBy(*keys, "display_order")
            .select(*keys, "account_id", "name", "account_type", "institution"))


def snapshot_log(snapshots: DataFrame, accounts: DataFrame, n: int = 200, keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` snapshots of registered accounts, with the account's name; with ``keys``, of each entity."""
    keys = list(keys)
    named = snapshots.join(accounts.select(*keys, "account_id", F.col("name").alias("account")),
                           [*keys, "account_id"])
    newest = [F.desc("snapshot_date"), F.desc("entered_at"), F.col("snapshot_id")]
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
        log = named.withColumn("place", place).where(F.col("place") <= n)
    else:
        log = named.orderBy(*newest).limit(n)
    return log.select(*keys, "snapshot_date", "account", "balance", "note", "snapshot_id", "entered_at")
