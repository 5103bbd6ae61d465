"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Only what results depend on; sizing (executors, shuffle partitions) stays with the cluster.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in {**REQUIRED, **RECOMMENDED}.items():
        spark.conf.set(k, v)
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time of the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def local_session(cores: str | int = "*", app: str = "cashweave", **conf) -> SparkSession:
    """A session for tests and benches on one machine; no web page, no fixed ports."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster is refused, because
    a machine-local folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="cashweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, within the folder of the innermost :func:`scratch` block if there is one."""
    return f"{(_scratch.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All scratch paths made inside the block lie in one folder, which is removed at its end: what the block returns
    must be written elsewhere by then."""
    root = scratch_path(spark, "scratch")
    token = _scratch.set(root)
    try:
        yield root
    finally:
        _scratch.reset(token)
        remove(spark, root)


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: worked out once, and there if an executor is lost."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that stages frames in a folder of their own, which is removed at the end."""
    with scratch(spark) as root:
        yield lambda df, name: staged(df, f"{root}/{name}")
