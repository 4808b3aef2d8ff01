"""Tables that loops keep between rounds, in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the session runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, _own.get(app) or "file://" + tempfile.mkdtemp(prefix="chronoweave-"))


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def clear(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables, or all that are left, once nothing reads them any more."""
    for path in [t.table_path for t in tables] or list(_made):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def numbered(df: DataFrame, order: str | list[str], name: str = "number") -> DataFrame:
    """df with a number from 0 in the order of columns, without bringing all rows to one task: ranges are counted, then numbered from where each begins."""
    from pyspark.sql import Window

    order = [order] if isinstance(order, str) else order
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start")
    out.table_path = ranged.table_path  # what clear() deletes once the numbers have been written
    return out
