"""Parquet tables: full refresh, replacement by source file, insert-only and delete-by-key.

Parquet has no row-level updates. Writers only ever add folders, each complete when its ``_SUCCESS`` is there, and small
append-only logs beside the data say which rows still count: readers leave out the others (merge on read), and
compaction is a job of its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schemas import conform, keyed
from ..session import setting

LOAD = "load_id"
MANIFEST = "_files"         # beside the loads: which files each of them holds
TOMBSTONES = "_deleted"     # inside a version: the keys deleted from it
PUBLISHED = "_published"    # below a layer: the folder of every table of one refresh
EVEN = 4                    # a bucket may hold this many times the mean of all buckets,
SMALL = 1_000_000           # or so many rows whatever the mean
BUCKET = 4_000_000          # rows of a bucket, in the mean, beyond which there are more buckets
CODEC = "zstd"              # of the tables that loads and refreshes write
POINTER = "name string, folder string, buckets int"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --- folders ---------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _subfolders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers ``n`` of the folders ``path/<prefix>n``."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(rf"{prefix}(\d+)", n)))


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, marker = _folder(spark, f"{folder}/_SUCCESS")
    return fs.exists(marker)


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete refresh; a refresh that broke off is not complete."""
    for n in reversed(_subfolders(spark, path, "v")):
        if _complete(spark, f"{path}/v{n}"):
            return f"{path}/v{n}"
    return None


def _next_version(spark: SparkSession, path: str) -> str:
    done = _subfolders(spark, path, "v")
    return f"{path}/v{done[-1] + 1 if done else 0}"


# --- writers ---------------------------------------------------------------------------------


def once(spark: SparkSession):
    """A block whose writes leave no shuffle files behind: what a write has moved is read by that write alone."""
    return setting(spark, CLEANUP, "true")


def write_full(df: DataFrame, path: str, partition_by: Sequence[str] = (), deal: bool = True) -> str:
    """Replace a derived table. A new folder is written, so the one being read stays intact.

    Rows are not sorted globally. With partitions, the rebalance hint lets Spark split large and
    merge small ones, so a partition holding a third of the rows is written by many tasks. Without ``deal``
    no row is moved: every task adds a file to each partition it has rows of, which suits frames read from files.
    """
    target = _next_version(df.sparkSession, path)
    out = df.hint("rebalance", *partition_by) if partition_by and deal else df
    with once(df.sparkSession):
        out.write.mode("errorifexists").option("compression", CODEC).partitionBy(*partition_by).parquet(target)
    return target


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version. Columns that older files lack come back as NULL under ``schema``."""
    folder = latest_version(spark, path)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(folder)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to the newest complete version of a table; without one, to a folder no refresh has touched."""
    spark = rows.sparkSession
    begun = _subfolders(spark, path, "v")
    rows.write.mode("append").parquet(
        latest_version(spark, path) or f"{path}/v{begun[-1] + 1 if begun else 0}")


# --- tables bucketed by entity ---------------------------------------------------------------


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket that Spark's writer puts a row into."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def deal_out(df: DataFrame, keys: Sequence[str], buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows of a bucket (and partition) brought together, by many tasks where there are many."""
    return df.withColumn("__bucket", bucket_of(keys, buckets)).hint("rebalance", *partition_by, "__bucket").drop("__bucket")


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, partition_by: Sequence[str] = (),
                   deal: bool = True, sort_by: Sequence[str] = ()) -> str:
    """:func:`write_full` with all rows of an entity (``keys``) in one of ``buckets`` buckets.

    ``deal`` first brings the rows of a partition and bucket together, so that they become few files; those of an entity that
    holds a third of all rows are still written by many tasks, as several files of one bucket. Rows that are already
    grouped by entity need no dealing. The files are ordinary Parquet: :func:`write_full`'s readers read them as well.
    ``sort_by`` orders the rows within a file, so that equal values lie together and take less room.
    """
    spark = df.sparkSession
    target, table = _next_version(spark, path), f"bucketed_{uuid.uuid4().hex}"
    out = deal_out(df, keys, buckets, partition_by) if deal else df
    writer = out.write.format("parquet").mode("errorifexists").option("compression", CODEC).bucketBy(buckets, *keys).option("path", target)
    writer = writer.sortBy(*sort_by) if sort_by else writer
    with once(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: the folder is not the catalog's
    return target


def enough_buckets(least: int, rows: int) -> int:
    """``least`` buckets, doubled until one holds at most ``BUCKET`` of ``rows`` in the mean: a bucket is one task's work,
    so it must not grow with the table."""
    buckets = least
    while buckets and rows > BUCKET * buckets:
        buckets *= 2
    return buckets


def stored_rows(spark: SparkSession, path: str) -> int:
    """The rows of all loads, replaced ones included; read from the files' footers."""
    return _read(spark, path, _loads(spark, path), T.StructType([])).count()


def is_even(rows: DataFrame, keys: Sequence[str], buckets: int) -> bool:
    """Whether no bucket is so large that the one task that would read it holds back a join: at most ``EVEN`` times the
    mean, or ``SMALL`` rows. Reads the keys only, and brings one row to the driver."""
    per_bucket = rows.groupBy(bucket_of(keys, buckets).alias("b")).agg(F.count("*").alias("n"))
    r = per_bucket.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    return r["most"] <= max(EVEN * r["all"] / buckets, SMALL)


def read_bucketed(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], buckets: int,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """A folder written by :func:`write_bucketed`, so that grouping, windows and joins by entity need no exchange.

    Spark learns of buckets only through a table of its catalog; one is entered and, as the frame needs it no more once it is
    resolved, taken out again. Nothing but the files has to be shared between sessions. Keys carry a mark in their
    metadata: it keeps them columns of the frame's own, without the table's name, as a union keeps its inputs' buckets
    only where the columns agree in all but their number.
    """
    def quoted(names: Sequence[str]) -> str:
        return ", ".join(f"`{n}`" for n in names)

    table = f"bucketed_{uuid.uuid4().hex}"
    ordered = sorted(schema, key=lambda f: f.name in partition_by)  # folders come last, as without buckets
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered)
    parts = f"PARTITIONED BY ({quoted(partition_by)})" if partition_by else ""
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    # Partitions are found in the folder, not in the catalog, which forgets the table at once.
    with setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts} CLUSTERED BY ({quoted(keys)}) "
                  f"INTO {buckets} BUCKETS LOCATION '{place}'")
        rows = spark.table(table).select(*(
            F.col(f.name).alias(f.name, metadata={"entity_key": True}) if f.name in keys else F.col(f.name) for f in ordered))
        spark.sql(f"DROP TABLE {table}")
    return rows


# --- replacement by source file --------------------------------------------------------------


def replace_by_file(batch: DataFrame, path: str, schema: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """Load ``batch`` so that each of its source files replaces its own earlier rows; returns the rows of this load.

    A load is a new folder of rows and, once that is complete, an entry in the manifest that names its files. Nothing
    that is already there is touched, however many files are sent again: a file's current rows are those of the
    newest load that names it, and :func:`read_loads` leaves out the others. A load that broke off has no entry and is
    never read. Loading a batch twice leaves the same rows; a file without rows replaces nothing. ``keys`` are
    further columns that name a file, as entities may use the same file names.
    """
    spark, names = batch.sparkSession, [*keys, "source_file"]
    loads = _subfolders(spark, path, f"{LOAD}=")
    folder = f"{LOAD}={loads[-1] + 1 if loads else 0}"
    with once(spark):
        conform(batch, schema, keys).write.mode("errorifexists").option("compression", CODEC).parquet(f"{path}/{folder}")
        written = spark.read.parquet(f"{path}/{folder}")
        # As many files as it takes: one task would count all files of all entities.
        (written.groupBy(*names).agg(F.count("*").alias("rows"))
         .write.mode("errorifexists").option("compression", CODEC).parquet(f"{path}/{MANIFEST}/{folder}"))
    return written


def _loads(spark: SparkSession, path: str) -> list[int]:
    """The loads that are complete and still there."""
    named = [n for n in _subfolders(spark, f"{path}/{MANIFEST}", f"{LOAD}=")
             if _complete(spark, f"{path}/{MANIFEST}/{LOAD}={n}")]
    return sorted(set(named) & set(_subfolders(spark, path, f"{LOAD}=")))


def _read(spark: SparkSession, path: str, loads: Sequence[int], schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(LOAD, T.IntegerType())])
    if not loads:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*(f"{path}/{LOAD}={n}" for n in loads))


def manifest(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per load and file: the file's ``rows`` and whether the load is the file's newest (``is_current``).
    Rows without a file name are current in every load."""
    names = [*keys, "source_file"]
    schema = keyed(T.StructType([T.StructField("source_file", T.StringType()), T.StructField("rows", T.LongType())]), keys)
    rows = _read(spark, f"{path}/{MANIFEST}", _loads(spark, path), schema)
    newest = F.max(LOAD).over(Window.partitionBy(*names))  # a partition holds the loads of one file
    return rows.withColumn("is_current", F.col("source_file").isNull() | (F.col(LOAD) == newest))


def read_loads(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The current rows of a table written by :func:`replace_by_file`; loads older than a column give NULL there.

    Rows are compared with the files that a newer load replaced, a table of names that Spark broadcasts while it is
    small; a table of one load is read as it is.
    """
    loads = _loads(spark, path)
    rows = _read(spark, path, loads, keyed(schema, keys))
    if len(loads) < 2:
        return rows
    stale = manifest(spark, path, keys).where("NOT is_current").select(
        *(F.col(c).alias(f"__{c}") for c in [*keys, "source_file", LOAD]))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col(LOAD) == F.col(f"__{LOAD}"))
    return rows.join(stale, same & (F.col("source_file") == F.col("__source_file")), "left_anti")


def compact_loads(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ()) -> list[int]:
    """Bring the current rows of all loads that hold replaced rows into one new load; returns those loads' numbers.

    Loads without replaced rows are not read. Rows without a file name stay where they are.
    """
    worn = manifest(spark, path, keys).where("NOT is_current").select(LOAD).distinct()
    touched = sorted(r[LOAD] for r in worn.collect())  # one row per load
    if touched:
        rows = read_loads(spark, path, schema, keys).where(F.col(LOAD).isin(touched) & F.col("source_file").isNotNull())
        replace_by_file(rows.drop(LOAD), path, schema, keys)
    return touched


def vacuum_loads(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> list[int]:
    """Delete the data of loads that hold no current row, and return their numbers; for when nobody reads them."""
    spent = manifest(spark, path, keys).groupBy(LOAD).agg(F.max("is_current").alias("used")).where("NOT used")
    gone = sorted(r[LOAD] for r in spent.collect())
    for n in gone:
        fs, folder = _folder(spark, f"{path}/{LOAD}={n}")
        fs.delete(folder, True)
    return gone


# --- one refresh of several tables -----------------------------------------------------------


def publish(spark: SparkSession, root: str, folders: Mapping[str, str], buckets: Mapping[str, int] | None = None) -> None:
    """Make one folder per table current, all at once: readers find them in one small file, complete or not there.
    ``buckets`` names the number of buckets of the tables to be read by bucket."""
    rows = spark.createDataFrame([(n, f.removeprefix(f"{root}/"), (buckets or {}).get(n)) for n, f in folders.items()], POINTER)
    rows.coalesce(1).write.mode("errorifexists").parquet(_next_version(spark, f"{root}/{PUBLISHED}"))


def published(spark: SparkSession, root: str) -> dict[str, tuple[str, int | None]]:
    """Folder and number of buckets (if any) per table of the newest published refresh; none if there is none."""
    pointer = latest_version(spark, f"{root}/{PUBLISHED}")
    if pointer is None:
        return {}
    return {r["name"]: (f"{root}/{r['folder']}", r["buckets"]) for r in spark.read.schema(POINTER).parquet(pointer).collect()}


def read_published(spark: SparkSession, root: str, name: str, schema: T.StructType, keys: Sequence[str] = (),
                   partition_by: Sequence[str] = ()) -> DataFrame:
    """A table as the newest published refresh has it; empty before the first. One published with buckets is read by them,
    given the ``keys`` and ``partition_by`` it was written with."""
    folder, buckets = published(spark, root).get(name, (None, None))
    if folder is None:
        return spark.createDataFrame([], schema)
    if buckets and keys:
        return read_bucketed(spark, folder, schema, keys, buckets, partition_by)
    return spark.read.schema(schema).parquet(folder)


# --- deletion by key -------------------------------------------------------------------------


def delete_rows(gone: DataFrame, path: str, on: Sequence[str]) -> None:
    """Delete rows of a table by key: the keys are added to a log inside the newest version, and no data is written."""
    version = latest_version(gone.sparkSession, path)
    if version is not None:
        gone.select(*on).distinct().coalesce(1).write.mode("append").parquet(f"{version}/{TOMBSTONES}")


def read_live(spark: SparkSession, path: str, schema: T.StructType, on: Sequence[str]) -> DataFrame:
    """A table without the rows that :func:`delete_rows` took out of it."""
    rows, version = read_table(spark, path, schema), latest_version(spark, path)
    if version is None or not _complete(spark, f"{version}/{TOMBSTONES}"):
        return rows
    keys = T.StructType([f for f in schema if f.name in on])
    return delete_by_key(rows, spark.read.schema(keys).parquet(f"{version}/{TOMBSTONES}"), on)


def compact_table(spark: SparkSession, path: str, schema: T.StructType, on: Sequence[str]) -> str:
    """A new version without the deleted rows and without a log of them."""
    return write_full(read_live(spark, path, schema, on), path)


# --- row-level operators ---------------------------------------------------------------------


def insert_missing(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``source`` whose key ``target`` does not have; existing rows are not touched."""
    return source.join(target.select(*on), list(on), "left_anti")


def delete_by_key(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``table`` without the rows whose key is in ``keys``."""
    return table.join(keys.select(*on), list(on), "left_anti")


def scan(table: DataFrame, where: Column | str | None = None,
         order_by: Sequence[Column | str] = (), limit: int | None = None) -> DataFrame:
    """All columns of a table, optionally filtered, ordered and limited."""
    out = table if where is None else table.where(where)
    out = out.orderBy(*order_by) if order_by else out
    return out if limit is None else out.limit(limit)
