"""Writing findings: CSV, a table with a partition per job, and JSON documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.findings import COLUMNS, SCHEMA
from clinisieve.operators.analytics import OPEN, severity_counts
from clinisieve.sources.store import Store

# Values are written as they are; missing and empty texts both as nothing.
CSV_OPTIONS = dict(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)


def write_csv(findings: DataFrame, folder: str, prefix: str = "findings") -> str:
    """Write findings under a name with the time in it, and return that path."""
    path = f"{folder.rstrip('/')}/{prefix}_{datetime.now():%Y-%m-%d_%H-%M-%S}"
    findings.select(*COLUMNS).write.options(**CSV_OPTIONS).csv(path)
    return path


def stored_shape(findings: DataFrame, tenant_id: str, job_id: str, study_id: str) -> DataFrame:
    """Findings as they are stored: owned by a job, open, and null where there is no text."""
    return findings.select(
        F.lit(tenant_id).alias("tenant_id"), F.lit(job_id).alias("job_id"), F.lit(study_id).alias("study_id"),
        *[F.nullif(F.col(c), F.lit("")).alias(c) if c in ("usubjid", "evidence") else F.col(c) for c in COLUMNS],
        F.lit(OPEN).alias("status"))


def findings_store(path: str) -> Store:
    """The table of all jobs' findings; a partition per job."""
    texts = ["tenant_id", "job_id", "study_id"]
    fields = [*(T.StructField(c, T.StringType()) for c in texts), *SCHEMA.fields,
              T.StructField("status", T.StringType()), T.StructField("created_at", T.TimestampType())]
    return Store(path, T.StructType(fields), ("tenant_id", "study_id", "job_id"))


def store_findings(findings: DataFrame, path: str, tenant_id: str, job_id: str, study_id: str) -> dict[str, int]:
    """Store a job's findings in place of those it may have stored before; their counts by severity.

    The counts are taken while the findings are written, so they are read once.
    """
    store, counted = findings_store(path), Observation()
    rows = stored_shape(findings, tenant_id, job_id, study_id).withColumn("created_at", F.current_timestamp())
    store.replace(rows.observe(counted, *severity_counts()))
    if not counted.get["total"]:  # nothing to put in place of what there was
        store.remove(findings.sparkSession, tenant_id=tenant_id, job_id=job_id, study_id=study_id)
    return dict(counted.get)


def findings_documents(findings: DataFrame) -> DataFrame:
    """One JSON document per finding, as a search index would take it in."""
    return findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(findings: DataFrame, path: str) -> None:
    findings_documents(findings).write.text(path)
