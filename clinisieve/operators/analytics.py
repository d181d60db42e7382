"""Questions asked of stored findings, jobs, datasets and studies: counts, listings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve import vocab
from clinisieve.functions import text
from clinisieve.functions import values as v
from clinisieve.operators.joins import lookup_join

# Limits of the listings and reports.
DETAIL_ROWS, TOP_FINDINGS, CONTEXT_FINDINGS, LATEST_JOBS = 200, 30, 50, 10
SAMPLE_READ, SAMPLE_SHOWN, MAX_PAGE = 20, 5, 1000
COMPLETED, ARCHIVED, FAILED, ACTIVE, OPEN = "completed", "archived", "failed", "active", "open"


def severity_rank(severity: str = "severity") -> Column:
    """0 for the worst severity; anything unknown comes last."""
    rank = F.lit(len(vocab.SEVERITIES))
    for i, name in reversed(list(enumerate(vocab.SEVERITIES))):
        rank = F.when(F.col(severity) == name, F.lit(i)).otherwise(rank)
    return rank


# --- counts -----------------------------------------------------------------------------------

def severity_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES]]


def summary_by_severity(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total and one column per severity, zeros included; per job or study with ``by``."""
    return findings.groupBy(*by).agg(*severity_counts())


def summary_by_domain(findings: DataFrame) -> DataFrame:
    """Findings per domain, the most first."""
    return findings.groupBy("domain").agg(F.count(F.lit(1)).alias("findings")).orderBy(
        F.desc("findings"), "domain")


def ranked_domains(findings: DataFrame) -> DataFrame:
    """The summary by domain with the ``position`` of each, from 0; only the counts are ordered as a whole."""
    order = Window.orderBy(F.desc("findings"), "domain")
    return summary_by_domain(findings).withColumn("position", (F.row_number().over(order) - 1).cast("bigint"))


def domain_map(findings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per job, a map from domain to its number of findings (counted before it is gathered)."""
    counts = findings.groupBy(*by, "domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))).alias("domains"))


def kpi_status(studies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active and archived studies; completed and failed jobs among the latest ten."""
    latest = jobs.orderBy(F.desc("created_at"), "job_id").limit(LATEST_JOBS)
    s = studies.agg(F.count_if(F.col("status") == ACTIVE).alias("active_studies"),
                    F.count_if(F.col("status") == ARCHIVED).alias("archived_studies"))
    j = latest.agg(F.count_if(F.col("status") == COMPLETED).alias("completed_jobs"),
                   F.count_if(F.col("status") == FAILED).alias("failed_jobs"))
    return s.select("*", j.select("completed_jobs").scalar().alias("completed_jobs"),
                    j.select("failed_jobs").scalar().alias("failed_jobs"))


def repeated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that should be unique but occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# --- listings -----------------------------------------------------------------------------------

def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant_id)


def list_findings(findings: DataFrame, *, tenant_id: str | None = None, study_id: str | None = None,
                  job_id: str | None = None, domain: str | None = None, severity: str | None = None,
                  status: str | None = None, usubjid: str | None = None, offset: int = 0,
                  limit: int = 100) -> DataFrame:
    """A page of findings, the worst and then the oldest first."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative and limit must be 1 to {MAX_PAGE}")
    wanted = {"tenant_id": tenant_id, "study_id": study_id, "job_id": job_id,
              "domain": domain and domain.upper(), "severity": severity and severity.upper(),
              "status": status and status.lower(), "usubjid": usubjid}
    for column, value in wanted.items():
        if value:
            findings = findings.filter(F.col(column) == value)
    return findings.orderBy(severity_rank(), "created_at", "id").offset(offset).limit(limit)


def list_audit(audit: DataFrame, *, tenant_id: str | None = None, action: str | None = None,
               user_id: str | None = None, since=None, until=None, offset: int = 0,
               limit: int = 50) -> DataFrame:
    """Audit rows, newest first; ``action`` is found anywhere in the action, in either case."""
    if tenant_id:
        audit = tenant_scope(audit, tenant_id)
    if action:
        audit = audit.filter(F.contains(F.lower("action"), F.lit(action.lower())))
    if user_id:
        audit = audit.filter(F.col("user_id") == user_id)
    if since is not None:
        audit = audit.filter(F.col("occurred_at") >= F.lit(since).cast(audit.schema["occurred_at"].dataType))
    if until is not None:
        audit = audit.filter(F.col("occurred_at") <= F.lit(until).cast(audit.schema["occurred_at"].dataType))
    return audit.orderBy(F.desc("occurred_at"), "id").offset(offset).limit(limit)


def list_latest(df: DataFrame, key: str, study_id: str | None = None, offset: int = 0,
                limit: int | None = None) -> DataFrame:
    """Studies, datasets, jobs or reports, newest first."""
    if study_id:
        df = df.filter(F.col("study_id") == study_id)
    ordered = df.orderBy(F.desc("created_at"), key)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def latest_per(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row per key.

    Spark limits each key to one row before the shuffle, so a key with many rows costs no more.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def latest_job_per_study(jobs: DataFrame) -> DataFrame:
    done = jobs.filter(F.col("status") == COMPLETED)
    return latest_per(done, ["tenant_id", "study_id"], "completed_at", "job_id")


def latest_per_domain(datasets: DataFrame) -> DataFrame:
    """The dataset that counts for a study's domain: the newest."""
    return latest_per(datasets, ["tenant_id", "study_id", "domain"], "created_at", "dataset_id")


def selectable_studies(studies: DataFrame) -> DataFrame:
    return studies.filter(F.col("status") != ARCHIVED)


def reportable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == COMPLETED)


def job_datasets(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """The datasets that each job names."""
    named = jobs.select("tenant_id", "job_id", F.explode("dataset_ids").alias("dataset_id"))
    return lookup_join(named, datasets, ["tenant_id", "dataset_id"], "inner")


def dataset_sample(df: DataFrame, read: int = SAMPLE_READ, shown: int = SAMPLE_SHOWN) -> DataFrame:
    """The first rows of a dataset by their positions, for a look at it; ``df`` is numbered in ``row_index``."""
    return df.orderBy("row_index").limit(min(read, shown))


# --- reports -----------------------------------------------------------------------------------

def report_order(findings: DataFrame) -> DataFrame:
    """By domain, then the worst first, then by row."""
    return findings.orderBy("domain", severity_rank(), "row_index", "id")


def report_detail(findings: DataFrame) -> DataFrame:
    """The first rows of a report, with value and message cut to what a page holds."""
    first = findings.orderBy("domain", severity_rank(), "row_index", "id").limit(DETAIL_ROWS)
    return first.select(
        "domain", "rule_id", "severity", "field",
        F.left(F.coalesce("evidence", F.lit("")), F.lit(text.EVIDENCE_LIMIT)).alias("value"),
        text.shorten_message(F.coalesce("message", F.lit("")), text.REPORT_MESSAGE_LIMIT).alias("message"))


def report_text_lines(findings: DataFrame) -> DataFrame:
    return findings.select("id", text.report_line(
        F.col("severity"), F.col("domain"), F.col("rule_id"), F.col("field"), F.col("evidence"),
        F.col("message")).alias("line"))


def job_duration(jobs: DataFrame) -> DataFrame:
    """Seconds a job took, to one decimal; null while it runs."""
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp"))
               - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    return jobs.select("job_id", F.round(seconds, 1).alias("duration_s"))


def report_header(jobs: DataFrame, tenants: DataFrame, studies: DataFrame) -> DataFrame:
    """Each job with the name of its tenant and the particulars of its study, where known."""
    t = tenants.select("tenant_id", F.col("name").alias("tenant_name"))
    s = studies.select("tenant_id", "study_id", "title", "phase", "sponsor", "therapeutic_area")
    joined = lookup_join(jobs.select("tenant_id", "study_id", "job_id", "status"), t, ["tenant_id"], "left")
    joined = lookup_join(joined, s, ["tenant_id", "study_id"], "left")
    return joined.withColumn("tenant_name", F.coalesce("tenant_name", "tenant_id"))


def top_findings_per_job(findings: DataFrame, limit: int = TOP_FINDINGS) -> DataFrame:
    """Up to ``limit`` CRIT and HIGH findings of each job, in report order of severity.

    Spark keeps only that many per job before the shuffle.
    """
    order = Window.partitionBy("job_id").orderBy(severity_rank(), "domain", "rule_id", "row_index", "id")
    worst = findings.filter(F.col("severity").isin(*vocab.SEVERITIES[:2]))
    ranked = worst.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return ranked.select("job_id", "position", "id", "rule_id", "severity", "domain", "field", "message",
                         "usubjid")


def query_context(findings: DataFrame, jobs: DataFrame, limit: int = CONTEXT_FINDINGS) -> DataFrame:
    """Severity counts over the first findings of each study's latest completed job."""
    latest = latest_job_per_study(jobs).select("job_id", "study_id")
    of_latest = lookup_join(findings.drop("study_id"), latest, ["job_id"], "inner")
    order = Window.partitionBy("job_id").orderBy("id")
    first = of_latest.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    return first.groupBy("study_id", "job_id").agg(*severity_counts())


def job_context(findings: DataFrame, jobs: DataFrame, studies: DataFrame) -> DataFrame:
    """Per completed job: counts by severity and domain, and the particulars of its study."""
    counts = summary_by_severity(findings, ("job_id",))
    domains = domain_map(findings, ("job_id",))
    s = studies.select("tenant_id", "study_id", "title", "phase", "sponsor", "therapeutic_area")
    context = reportable_jobs(jobs).select("tenant_id", "study_id", "job_id")
    context = context.join(counts, "job_id", "left").join(domains, "job_id", "left")
    context = lookup_join(context, s, ["tenant_id", "study_id"], "left")
    return context.fillna(0, ["total", *vocab.SEVERITIES])


# --- rule profiles ---------------------------------------------------------------------------------

def apply_rule_profile(findings: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drop the findings of switched-off rules and give others their new severity.

    ``overrides`` has one row per rule (and per ``keys``, such as the tenant): rule_id, severity
    and enabled, either of which may be null.
    """
    changes = overrides.select(*keys, "rule_id", F.col("severity").alias("_severity"),
                               F.col("enabled").alias("_enabled"))
    joined = lookup_join(findings, changes, [*keys, "rule_id"], "left")
    kept = joined.filter(F.coalesce("_enabled", F.lit(True)))
    return kept.withColumn("severity", F.coalesce("_severity", "severity")).select(*findings.columns)


def vocabulary_mismatches(df: DataFrame, test: str, unit: str, pairs: DataFrame) -> DataFrame:
    """Rows whose (test, unit) is not a listed pair, though the test is listed.

    For vocabularies kept as a table (``test``, ``unit``); the built-in ones are part of the rules.
    """
    rows = df.filter(F.col(unit).isNotNull()).withColumns({"test": v.clean(test), "unit": v.clean(unit)})
    known = lookup_join(rows, pairs.select("test").distinct(), ["test"], "left_semi")
    return lookup_join(known, pairs.select("test", "unit").distinct(), ["test", "unit"], "left_anti")
