"""What the study knows about each subject: where it occurs, and its date windows.

A subject is named by its cleaned USUBJID, so null and blank identifiers share the empty name.
Every table here has one row per subject and is built with partial sums before the shuffle.  Rows
without a date are not filtered out first, which would parse each date twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve import vocab
from clinisieve.functions import values as v
from clinisieve.operators.joins import has_rows, lookup_join

SUBJECT = "subject"
DISPOSITION = vocab.DS_CATEGORIES[0]


def subject() -> Column:
    return v.clean("USUBJID").alias(SUBJECT)


def distinct_subjects(df: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*scope, subject()).distinct()


def vs_date_range(vs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """First and last vital-signs date."""
    days = vs.select(*scope, subject(), v.iso_date("VSDTC").alias("d"))
    return days.groupBy(*scope, SUBJECT).agg(F.min("d").alias("vs_min"), F.max("d").alias("vs_max")).filter(
        "vs_min IS NOT NULL")


def cm_window(cm: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """First start and last end over the medications with a start date."""
    start = v.iso_date("CMSTDTC")
    days = cm.select(*scope, subject(), start.alias("st"), F.when(start.isNotNull(), v.iso_date("CMENDTC")).alias("en"))
    return days.groupBy(*scope, SUBJECT).agg(F.min("st").alias("cm_min"), F.max("en").alias("cm_max")).filter(
        "cm_min IS NOT NULL")


def is_disposition(ds: DataFrame) -> Column:
    if "DSCAT" not in ds.columns:
        return F.lit(False)
    return v.clean("DSCAT") == DISPOSITION


def choose_exit(per_subject: DataFrame, ds: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Keep the disposition events' date if the study has any such event, else any row's date."""
    events = ds.filter(is_disposition(ds))
    if scope:
        studies = events.select(*scope).distinct().withColumn("_any", F.lit(True))
        marked = lookup_join(per_subject, studies, list(scope), "left")
        only_events = F.coalesce(F.col("_any"), F.lit(False))
    else:
        marked, only_events = per_subject, has_rows(events)
    return marked.withColumn(
        "ds_exit", F.when(only_events, F.col("exit_event")).otherwise(F.col("exit_any"))
    ).drop("_any", "exit_event", "exit_any")


def ds_exit_date(ds: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Earliest date on which a subject left the study."""
    days = ds.select(*scope, subject(), v.iso_date("DSSTDTC").alias("d"),
                     is_disposition(ds).alias("event"))
    per_subject = days.groupBy(*scope, SUBJECT).agg(
        F.min(F.when(F.col("event"), F.col("d"))).alias("exit_event"), F.min("d").alias("exit_any"))
    return choose_exit(per_subject, ds, scope).filter("ds_exit IS NOT NULL")
