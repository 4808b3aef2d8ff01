"""Counting and scoring functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def entropy(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """entropy, in natural logarithms, of the counts n of each group of by."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("p", p).where("p > 0").groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def scaled(value: str, by: list[str]) -> Column:
    """(value - least) / (most - least) within by; null where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.try_divide(F.col(value) - low, high - low)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, for n up to 20."""
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise((F.factorial(n.cast("int")) / (F.factorial(k.cast("int")) * F.factorial((n - k).cast("int")))).cast("long"))


def frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """rows whose key occurs least times or more in rows."""
    often = rows.groupBy(*key).agg(F.count("*").alias("occurs")).where(F.col("occurs") >= least).select(*key)
    return rows.join(often, key, "left_semi")
