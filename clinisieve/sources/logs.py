"""Log files: one entry per well-formed line, other lines are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The form of a log line.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(.+)$"


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_log(spark.read.text(path))


def parse_log(lines: DataFrame) -> DataFrame:
    """``lines`` has the text in ``value``; white space at its end does not count."""
    line = F.regexp_replace("value", r"\s+$", "")
    return lines.select(
        F.regexp_extract(line, LINE, 1).try_cast("timestamp_ntz").alias("timestamp"),
        F.regexp_extract(line, LINE, 2).alias("level"),
        F.regexp_extract(line, LINE, 3).alias("message")).filter("timestamp IS NOT NULL")


def by_level(entries: DataFrame, level: str) -> DataFrame:
    return entries.filter(F.col("level") == level.upper())
