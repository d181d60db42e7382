"""Changes to stored tables as joins: audit rows, resolutions, partial updates, soft deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve.functions.hashing import row_hash
from clinisieve.operators.analytics import ARCHIVED, OPEN
from clinisieve.operators.joins import lookup_join

# The tables whose changes are recorded, and the states a finding may be closed with.
AUDITED = ("studies", "datasets", "validation_jobs", "findings", "compliance_reports",
           "electronic_signatures", "users")
CLOSING = ("resolved", "waived")


def audit_diff(before: DataFrame, after: DataFrame, table: str, key: str = "id") -> DataFrame:
    """One row per created, updated or deleted record of an audited table.

    A creation or update carries the hash of the new content, a deletion that of the old one.
    """
    if table not in AUDITED:
        raise ValueError(f"{table} is not audited")
    old = before.select(F.col(key).alias("target_id"), row_hash(before.columns).alias("_old"))
    new = after.select(F.col(key).alias("target_id"), row_hash(after.columns).alias("_new"))
    changed = old.join(new, "target_id", "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    verb = (F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete")
            .otherwise("update"))
    return changed.select(
        F.concat(F.lit(f"{table}."), verb).alias("action"), "target_id",
        F.when(F.col("_new").isNull(), F.col("_old")).otherwise("").alias("before_hash"),
        F.coalesce("_new", F.lit("")).alias("after_hash"))


def _first_valid(requests: DataFrame) -> DataFrame:
    """Per finding, the earliest request with a permitted state (one row per finding, even if a request is repeated)."""
    valid = requests.filter(F.col("new_status").isin(*CLOSING))
    return valid.groupBy("id").agg(F.min(F.struct(
        "requested_at", "request_id", "new_status", "user_id", "note")).alias("first")).select("id", "first.*")


def apply_resolutions(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Close open findings as requested; the earliest permitted request for a finding counts.

    ``requests`` has request_id, id, new_status, user_id, requested_at and note.
    """
    chosen = _first_valid(requests).select(
        "id", F.col("new_status").alias("_status"), F.col("user_id").alias("_user"),
        F.col("requested_at").alias("_at"), F.col("note").alias("_note"))
    joined = findings.join(chosen, "id", "left")
    close = (F.col("status") == OPEN) & F.col("_status").isNotNull()
    return joined.select(
        *[c for c in findings.columns if c not in ("status", "resolved_by", "resolved_at", "resolution_note")],
        F.when(close, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(close, F.col("_user")).otherwise(F.col("resolved_by")).alias("resolved_by"),
        F.when(close, F.col("_at")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(close, F.col("_note")).otherwise(F.col("resolution_note")).alias("resolution_note"))


def resolution_rejects(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests that change nothing, and why."""
    first = _first_valid(requests).select("id", "request_id", F.lit(True).alias("_first"))
    joined = lookup_join(requests, findings.select("id", "status"), ["id"], "left").join(
        first, ["id", "request_id"], "left")
    reason = (
        F.when(~F.col("new_status").isin(*CLOSING), "status must be 'resolved' or 'waived'.")
        .when(F.col("status").isNull(), "Finding not found.")
        .when(F.col("status") != OPEN, F.concat(F.lit("Finding is already '"), F.col("status"), F.lit("'.")))
        .when(F.col("_first").isNull(), "Finding is already closed by an earlier request."))
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        "request_id", "id", "new_status", "reason")


def soft_delete(df: DataFrame, key: str, doomed: DataFrame) -> DataFrame:
    """Archive the named records; nothing is removed."""
    marks = doomed.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(marks, key, "left").withColumn(
        "status", F.when(F.col("_gone"), F.lit(ARCHIVED)).otherwise(F.col("status"))).drop("_gone").select(
            *df.columns)


def partial_update(df: DataFrame, key: str, updates: DataFrame) -> DataFrame:
    """Overwrite only the fields that an update gives; its nulls leave the old value."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return df.join(new, key, "left").select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])

