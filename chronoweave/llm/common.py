"""Shared pieces: scratch tables in the cluster's checkpoint folder and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
#: Paths of tables that are still there, oldest first, and who made each.
_made: dict[str, str | None] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and the session runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made[path] = _owner.get()
    return path


@contextmanager
def owned(name: str):
    """Tables made meanwhile, in this thread, are those of name: scratch_made(name) lists them, whatever others make beside."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table in tables:
        path = table if isinstance(table, str) else table.table_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.pop(path, None)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for tables whose rows are large; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy() -> None:
    """Gives memory that a batch's objects leave behind back to the system: workers live on, and others run beside them."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that are gone (the last job's excepted): it looks for those when the driver collects garbage."""
    spark._jvm.System.gc()


def scratch_made(owner: str | None = None) -> list[str]:
    """Paths of the tables that are still there, oldest first: all, or those of one owner."""
    return [path for path, own in _made.items() if owner is None or own == owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from names."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def unsigned_hash01(*cols: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash of cols: the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
