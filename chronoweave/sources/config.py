"""Configuration and list files: properties with variables, sieve lists, counts and plain lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> list[str]:
    """A configuration file's lines; such files are a few lines long."""
    return [r.value for r in spark.read.text(path).collect()]


@dataclass
class Properties:
    """Keys with text values; {name} in a value stands for another key's value."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: list[str]) -> Properties:
        found = {}
        for line in lines:
            line = re.split(r"(?:^|\s)//", line)[0].strip()
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                found[key.strip()] = value.strip()
        return cls(found)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Properties:
        return cls.parse(_lines(spark, path))

    def text(self, key: str, default: str | None = None) -> str | None:
        value, seen = self.values.get(key, default), {key}
        while value and (m := re.search(r"\{([\w.]+)\}", value)) and m[1] in self.values and m[1] not in seen:
            seen.add(m[1])
            value = value.replace(m[0], self.values[m[1]])
        return value

    def number(self, key: str, default: float | None = None) -> float | None:
        value = self.text(key)
        return default if value is None else float(value)

    def integer(self, key: str, default: int | None = None) -> int | None:
        value = self.text(key)
        return default if value is None else int(value)

    def flag(self, key: str, default: bool = False) -> bool:
        value = self.text(key)
        return default if value is None else value.lower() in ("true", "yes", "1")

    def items(self, key: str) -> list[str]:
        return [x for x in re.split(r"[\s,]+", self.text(key) or "") if x]


def sieve_names(lines: list[str]) -> list[str]:
    """One name a line; what follows // is a comment."""
    return [name for line in lines if (name := line.split("//")[0].strip())]


def load_sieve_names(spark: SparkSession, path: str) -> list[str]:
    return sieve_names(_lines(spark, path))


def counts(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """key, n of lines with a key, a tab and a count of at least least."""
    out = spark.read.schema("key string, n long").option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)
    return out.where(F.col("n") >= least)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def integers(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line").try_cast("long").alias("n")).where("n IS NOT NULL")


def nearest_name(names: DataFrame, wanted: str) -> DataFrame:
    """The name (column name) with the least edit distance, the first of those tied."""
    return names.agg(F.min_by("name", F.struct(F.levenshtein("name", F.lit(wanted)), "name")).alias("name"))
