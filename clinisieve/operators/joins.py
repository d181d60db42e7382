"""Equi-joins of a large event table to a lookup table, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def has_rows(df: DataFrame) -> Column:
    """Whether a table has any row, as a scalar that is worked out once when the query runs."""
    return df.limit(1).agg(F.count(F.lit(1)) > 0).scalar()


def lookup_join(events: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join ``events`` to ``lookup`` on equal, non-null keys (inner, left, left_semi, left_anti).

    How it runs is Spark's choice when it runs: a small lookup is shipped and the events stay where they are;
    else both are shuffled, and the events of a hot key, however many such keys there are, are split over several tasks, each with
    that key's lookup rows.  Both need adaptive execution, which is on unless a session turns it off.
    """
    return events.join(lookup, on, how)
