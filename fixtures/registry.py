"""All registered queries, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.functions import text
from clinisieve.functions import values as v
from clinisieve.functions.hashing import row_hash
from clinisieve.operators import analytics, changes, cross, facts, features, outliers, pages, subjects
from clinisieve.findings import union_findings
from clinisieve.operators.domains import DOMAINS, validate_domain
from clinisieve.plans import pipeline
from clinisieve.sources import dataset_json, files, form_export, large_documents, logs, rowid, scratch, sinks, store
from clinisieve.streaming import changes as stream_changes
from clinisieve.streaming import subjects as stream_subjects
from clinisieve.streaming import windows
from fixtures import documents as docs
from fixtures import oracle_cross as x
from fixtures import oracle_rules as o
from fixtures import oracle_store as st
from fixtures.oracle_documents import documents_sql
from fixtures.tables import base, domains, view
from fixtures.views import STUDY_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = sql


def _rule_query(domain: str, number: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = validate_domain(view(spark, sf_dir, domain), domain.upper(),
                                only={f"SDTM_{domain.upper()}_{number}"})
        return found if domain in o.HAS_ROW_ID else found.drop("row_index")
    return build


for _domain, _rules in o.RULES.items():
    for _number in _rules:
        register(f"rule_{_domain}_{_number}", _rule_query(_domain, _number), o.rule_sql(_domain, _number))


# --- cross-domain rules -------------------------------------------------------------------------

def _positions(df: DataFrame, domain: str) -> DataFrame:
    return df if domain in o.HAS_ROW_ID else df.drop("row_index")


def _link_query(domain: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _positions(cross.dm_link(view(spark, sf_dir, "dm"), view(spark, sf_dir, domain), domain.upper()),
                          domain)
    return build


for _domain in x.LINKED:
    register(f"dmlink_{_domain}", _link_query(_domain),
             f"WITH {o.domain_cte('dm', _domain)} {x.link_select(_domain)}")


def _cross_query(key: str):
    rule_id = key.upper()

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = {d: view(spark, sf_dir, d) for d in {*x.CROSS_NEEDS[key], *(("dm",) if "irt" in key else ())}}
        if key.startswith("x_vsae"):
            return cross.vs_ae(t["vs"], t["ae"], only={rule_id})
        if key.startswith("x_vscm"):
            return _positions(cross.vs_cm(t["vs"], t["cm"], only={rule_id}), "cm" if key.endswith("1") else "vs")
        return cross.irt(t["dm"], t["ex"], t.get("ds"), only={rule_id})
    return build


for _key, _sql in x.cross_selects().items():
    register(_key, _cross_query(_key), f"WITH {o.domain_cte(*x.CROSS_NEEDS[_key])} {_sql}")

register("vs_date_range", lambda s, d: subjects.vs_date_range(view(s, d, "vs")),
         f"WITH {o.domain_cte('vs')} {x.VS_RANGE}")
register("cm_window", lambda s, d: subjects.cm_window(view(s, d, "cm")),
         f"WITH {o.domain_cte('cm')} {x.CM_WINDOW}")
register("ds_exit_date", lambda s, d: subjects.ds_exit_date(view(s, d, "ds")),
         f"WITH {o.domain_cte('ds')} {x.DS_EXIT}")


# --- features, range rules, whole validations ---------------------------------------------------

def _frame_domains(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return domains(spark, sf_dir, x.FRAME_DOMAINS)


def _feature_query(name: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        domain = x.FEATURE_SQL[name][0]
        rows = facts.subject_facts({domain.upper(): view(spark, sf_dir, domain)}, with_presence=False,
                                   features={name})
        return facts.subject_features(rows).filter(f"{name} IS NOT NULL")
    return build


for _name in x.FEATURE_SQL:
    register("feat_first_vsdtc" if _name == "VSDTC" else f"feat_{_name.lower()}", _feature_query(_name),
             x.feature_sql(_name))

register("feature_frame", lambda s, d: features.feature_frame(_frame_domains(s, d)),
         f"WITH {o.domain_cte(*x.FRAME_DOMAINS)} {x.frame_select()}")


def _generic_query(key: str):
    rule_id = f"GENERIC_{key.removeprefix('generic_').upper()}_001"

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = features.range_findings(features.flagged_features(_frame_domains(spark, sf_dir)))
        return found.filter(found.rule_id == rule_id)
    return build


for _key in x.generic_selects():
    register(_key, _generic_query(_key), x.generic_sql(_key))


def _validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.validate_all(domains(spark, sf_dir), outliers=False).drop("row_index")


def _validate_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules of tables whose numbers and days have types, as most stored tables have them."""
    parts = []
    for domain, kinds in o.TYPED.items():
        df = view(spark, sf_dir, domain)
        df = df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})
        parts.append(validate_domain(df, domain.upper()).drop("row_index"))
    return union_findings(parts)


register("validate_typed", _validate_typed, o.typed_sql())


def _lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain without two of the columns that it cannot do without."""
    return union_findings([validate_domain(df.drop(*DOMAINS[code].required[:2]), code)
                           for code, df in domains(spark, sf_dir).items()])


def _links_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = domains(spark, sf_dir)
    return union_findings([cross.dm_link(tables["DM"], df.drop("USUBJID"), code) for code, df in tables.items() if code != "DM"])


def _pairs_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = domains(spark, sf_dir, ("dm", "vs", "ae", "cm", "ex"))
    return union_findings([cross.vs_ae(t["VS"].drop("VSDTC"), t["AE"]), cross.vs_cm(t["VS"], t["CM"].drop("CMSTDTC")),
                           cross.irt(t["DM"].drop("RFSTDTC"), t["EX"], None)])


register("rule_required_columns", _lacking, o.lacking_sql({code.lower(): d.required[:2] for code, d in DOMAINS.items()}))
register("dmlink_missing_col", _links_lacking, o.links_lacking_sql([c.lower() for c in DOMAINS if c != "DM"]))
register("x_required_columns", _pairs_lacking, o.pairs_lacking_sql())
register("validate_rules", _validate_rules, f"{x.all_rules_sql()} SELECT * FROM all_findings")
register("validate_all", lambda s, d: pipeline.validate_all(domains(s, d)))


def _outlier_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect_outliers(features.flagged_features(_frame_domains(spark, sf_dir)))


register("anomaly_flags", lambda s, d: _outlier_frame(s, d).select("row_index", "USUBJID", "anomaly"))
register("anomaly_findings", lambda s, d: outliers.outlier_findings(_outlier_frame(s, d)))


# --- stored findings: listings, reports, changes -----------------------------------------------------

def _stored(build: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over derived tables, in the order named."""
    return lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in names])


def _domain_text(df: DataFrame) -> DataFrame:
    """The map as text, since engines differ in how they hand over maps."""
    return df.withColumn("domains", F.expr(
        "array_join(transform(array_sort(map_entries(domains)), e -> e.key || '=' || e.value), ';')"))


def _findings_with_ids(df: DataFrame) -> DataFrame:
    return df.select("id", "status", "resolved_by", "resolved_at", "resolution_note")


STORED = {
    "list_findings": (lambda f: analytics.list_findings(
        f, tenant_id="T1", domain="ae", status="OPEN", offset=20, limit=100), "findings"),
    "report_order": (lambda f: pages.positioned(f, pages.report_order()).select(
        "position", "id", "domain", "severity", "row_index"), "findings"),
    "report_detail": (analytics.report_detail, "findings"),
    "report_summary": (lambda f: analytics.summary_by_severity(f, ("job_id",)), "findings"),
    "report_text_lines": (analytics.report_text_lines, "findings"),
    "report_header": (analytics.report_header, "jobs", "tenants", "known_studies"),
    "top_findings_per_job": (analytics.top_findings_per_job, "findings"),
    "query_context": (analytics.query_context, "findings", "finding_jobs"),
    "job_context": (lambda f, j, s: _domain_text(analytics.job_context(f, j, s)), "findings", "jobs", "known_studies"),
    "summary_domain_map": (lambda f: _domain_text(analytics.domain_map(f, ("job_id",))), "findings"),
    "kpi_status": (analytics.kpi_status, "studies", "jobs"),
    "unique_study": (lambda s: analytics.repeated_keys(s, ("tenant_id", "study_id")), "studies"),
    "latest_job_per_study": (lambda j: analytics.latest_job_per_study(j).select(
        "tenant_id", "study_id", "job_id", "completed_at"), "jobs"),
    "latest_dataset_per_study": (lambda d: analytics.latest_per(
        d, ["tenant_id", "study_id"], "created_at", "dataset_id").select(
            "tenant_id", "study_id", "dataset_id", "created_at"), "datasets"),
    "latest_per_domain": (lambda d: analytics.latest_per_domain(d).select(
        "tenant_id", "study_id", "domain", "dataset_id", "created_at"), "datasets"),
    "list_audit": (lambda a: analytics.list_audit(
        a, action="FINDINGS", since="2024-01-05 00:00:00", until="2024-01-20 12:00:00", offset=10, limit=50), "audit"),
    "list_latest": (lambda j: pages.positioned(j, pages.newest_first("job_id")).select(
        "position", "job_id", "study_id", "status", "created_at"), "jobs"),
    "list_latest_page": (lambda j: analytics.list_latest(j, "job_id", offset=100, limit=50).select(
        "job_id", "study_id", "status", "created_at"), "jobs"),
    "selectable_studies": (lambda s: analytics.selectable_studies(s).select("id", "status"), "studies"),
    "reportable_jobs": (lambda j: analytics.reportable_jobs(j).select("job_id", "status"), "jobs"),
    "tenant_scope": (lambda f: analytics.tenant_scope(f, "T2").select("id", "tenant_id"), "findings"),
    "job_datasets": (lambda j, d: analytics.job_datasets(j, d).select(
        "tenant_id", "job_id", "dataset_id", "study_id", "domain"), "jobs", "datasets"),
    "job_duration": (analytics.job_duration, "jobs"),
    "apply_rule_profile": (lambda f, p: analytics.apply_rule_profile(f, p, ("tenant_id",)).select(
        "id", "rule_id", "severity"), "findings", "overrides"),
    "apply_resolutions": (lambda f, r: _findings_with_ids(changes.apply_resolutions(f, r)), "findings", "requests"),
    "resolution_rejects": (changes.resolution_rejects, "findings", "requests"),
    "soft_delete": (lambda s, e: changes.soft_delete(s, "id", e).select("id", "status"), "studies", "study_edits"),
    "partial_update": (lambda s, e: changes.partial_update(s, "id", e).select("id", "title", "phase", "sponsor"),
                       "studies", "study_edits"),
    "row_hash": (lambda s: s.select("id", row_hash(s.columns).alias("hash")), "studies"),
    "audit_diff": (lambda b, a: changes.audit_diff(b, a, "studies"), "studies", "studies_after"),
    "findings_persist_shape": (lambda f: sinks.stored_shape(f, "T1", "J1", "ST1"), "findings"),
    "fn_truncate_message": (lambda f: f.select(
        "id", text.shorten_message(F.col("message"), 90).alias("short_90"),
        text.shorten_message(F.col("message"), 200).alias("short_200")), "findings"),
    "detect_format": (lambda d: files.with_format(d, "filename", "given_format").select(
        "dataset_id", "format", "allowed"), "datasets"),
    "replay_row_index": (lambda dm, ae: rowid.position_among_findings(cross.dm_link(dm, ae, "AE"), 1000).select(
        "rule_id", F.col("row_index").alias("source_row"), F.col("position").alias("row_index")), "dm", "ae"),
    "fn_clean": (lambda ex: ex.select("row_index", v.clean("EXROUTE").alias("route"), v.clean("EXTRT").alias("trt")), "ex"),
    "fn_blank": (lambda ds: ds.select("row_index", v.blank("DSTERM").alias("term_blank"),
                                      v.blank("USUBJID").alias("subject_blank")), "ds"),
    "fn_num": (lambda ex: ex.select("row_index", v.number("EXDOSE").alias("dose")), "ex"),
    "fn_num_comma": (lambda vs: vs.select("VSORRES", v.number_comma("VSORRES").alias("result")), "vs"),
    "fn_iso_date": (lambda dm: dm.select("row_index", v.iso_date("RFSTDTC").alias("rf_start"),
                                         v.iso_date("RFENDTC").alias("rf_end")), "dm"),
    "fn_message": (lambda dm: dm.select("row_index", F.expr(text.with_found_sql(
        "'Checked.'", "coalesce(SEX, '')")).alias("message")), "dm"),
    "fn_feature_evidence": (lambda dm: features.with_texts(
        dm.select("row_index", v.number("AGE").alias("AGE"),
                  F.expr("CASE WHEN row_index % 3 > 0 THEN row_index % 3 END").alias("PR_COUNT")),
        {"AGE": True}).transform(lambda d: d.select("row_index", features.evidence_list(d).alias("evidence"))), "dm"),
    "vocab_pair_lookup": (lambda vs: analytics.vocabulary_mismatches(
        vs, "VSTESTCD", "VSORRESU", vs.select(v.clean("VSTESTCD").alias("test"), v.clean("VSORRESU").alias("unit"))
        .filter("unit <> 'sec'")).groupBy("test", "unit").agg(F.count(F.lit(1)).alias("n")), "vs"),
}
for _name, (_build, *_names) in STORED.items():
    register(_name, _stored(_build, *_names), st.SQL[_name])


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.apply_ranges(features.feature_frame(_frame_domains(spark, sf_dir))).select(
        "row_index", "AGE_valid", "SYSBP_valid", "DOSE_valid", "date_valid")


def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = scratch.written(features.feature_frame(_frame_domains(spark, sf_dir)))
    filled = outliers.imputed(frame, [c for c in frame.columns if c in features.FEATURES])
    return frame.select("row_index", *[e.alias(c) for c, e in filled.items()])


register("apply_rules", _flags, st.SQL["apply_rules"])
register("impute_medians", _imputed, st.SQL["impute_medians"])


def _all_findings(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(pipeline.validate_all(domains(spark, sf_dir), outliers=False))


register("union_findings", _all_findings(lambda f: f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))),
         st.SQL["union_findings"])
register("summary_by_severity", _all_findings(analytics.summary_by_severity), st.SQL["summary_by_severity"])
register("summary_by_domain", _all_findings(analytics.ranked_domains), st.SQL["summary_by_domain"])


# --- windows over the event table ----------------------------------------------------------------------

def _is_error():
    return F.col("event_type") == "error"


register("failed_login_windows", lambda s, d: windows.failed_login_windows(
    base(s, d, "events"), _is_error(), width="1 day"), st.SQL["failed_login_windows"])
register("error_rate_windows", lambda s, d: windows.error_rate_windows(base(s, d, "events"), _is_error()),
         st.SQL["error_rate_windows"])
register("p99_windows", lambda s, d: windows.p99_windows(
    base(s, d, "events"), "value", width="1 hour", threshold=200.0), st.SQL["p99_windows"])


# --- rows as they arrive, and deep pages ---------------------------------------------------------------

def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """What a stream over a folder of files gives once all of them are read."""
    out, notes = scratch.new_path(spark, "out"), scratch.new_path(spark, "notes")
    query = df.writeStream.format("parquet").option("checkpointLocation", notes).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(folder)


def _audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All studies as new records, then what became of them; some come twice."""
    before, after, folder = view(spark, sf_dir, "studies"), view(spark, sf_dir, "studies_after"), scratch.new_path(spark, "changes")
    gone = before.join(after.select("id"), "id", "left_anti").select(*before.columns)
    batches = [before.withColumns({"seq": F.lit(1), "deleted": F.lit(False)}),
               after.withColumns({"seq": F.lit(2), "deleted": F.lit(False)}).unionByName(gone.withColumns({"seq": F.lit(2), "deleted": F.lit(True)})),
               after.where("id % 3 = 0").withColumns({"seq": F.lit(3), "deleted": F.lit(False)})]
    for rows in batches:
        rows.write.mode("append").parquet(folder)
    return _streamed(spark, stream_changes.audit_stream(_stream(spark, folder, batches[0].schema), "studies"))


def _stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "dm")
    view(spark, sf_dir, "dm").repartition(9).write.parquet(folder)
    return _streamed(spark, stream_subjects.stream_duplicate_subjects(_stream(spark, folder, spark.read.parquet(folder).schema)))


def _kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings counted in four batches, one of them run again after it found more."""
    found, kept = view(spark, sf_dir, "findings"), stream_changes.KeptCounts(scratch.new_path(spark, "counts"))
    for batch, rows in ((0, "id % 4 = 0"), (1, "id % 4 = 1"), (2, "id % 4 = 2 AND id % 3 = 0"), (3, "id % 4 = 3"), (2, "id % 4 = 2")):
        kept.add(found.where(rows), batch)
    return kept.by_domain(spark)


def _deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "pages")
    pages.lay_out(view(spark, sf_dir, "findings"), path, pages.findings_order(), ("tenant_id",), block=500)
    return pages.page(spark, path, 2950, 100, block=500, tenant_id="T1").select("position", "id", "severity", "created_at")


def _deep_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "pages")
    pages.lay_out(view(spark, sf_dir, "jobs"), path, pages.newest_first("job_id"), block=1000)
    return pages.page(spark, path, 9_990, 20, block=1000).select("position", "job_id", "created_at")


register("audit_stream", _audit_stream, st.SQL_SOURCES["audit_stream"])
register("stream_dm_002", _stream_duplicates, f"SELECT * FROM ({o.rule_sql('dm', '002')}) f")
register("summary_kept_up", _kept_up, st.SQL_SOURCES["summary_kept_up"])
register("deep_page_findings", _deep_page, st.SQL_SOURCES["deep_page_findings"])
register("deep_page_jobs", _deep_jobs, st.SQL_SOURCES["deep_page_jobs"])


# --- readers, over files and documents that Spark derives from the given tables ------------------------

def _scan_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_csv(spark, docs.csv_copy(view(spark, sf_dir, "ae"), "row_index"))


def _scan_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as CSV fields, with their line breaks and quotes, read in pieces shorter than many of them."""
    path = docs.csv_copy(base(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source"), "doc_id", drop=False)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    small.conf.set("spark.sql.files.openCostInBytes", "65536")
    # A task takes several pieces, so that the number of tasks does not grow with the text.
    small.conf.set("spark.sql.files.maxPartitionNum", str(max(200, 4 * spark.sparkContext.defaultParallelism)))
    return files.read_csv(small, path)


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "csv")
    view(spark, sf_dir, "dm").write.partitionBy("STUDYID").options(**sinks.CSV_OPTIONS).csv(path)
    counted = files.csv_row_counts(spark, path)
    return counted.groupBy(F.regexp_extract("file", "STUDYID=([^/]+)", 1).alias("dataset")).agg(
        F.sum("row_count").alias("row_count"))


def _documents(findings: DataFrame) -> DataFrame:
    """The documents read back, so that their content can be compared."""
    back = sinks.findings_documents(findings).select(F.from_json(
        "value", "id bigint, rule_id string, evidence string, created_at timestamp_ntz").alias("j"))
    return back.select("j.*")


def _dm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_json.domain_table(dataset_json.rows(docs.dataset_json(spark, sf_dir)), "DM").select(
        "doc_id", "row_index", "USUBJID", "STUDYID", "RFENDTC")


def _taken_apart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Large documents and their opened groups; a small limit, so that all are taken apart."""
    texts, chunks = large_documents.split_large(scratch.written(docs.large_documents(spark, sf_dir)), 1 << 15, 1 << 13)
    return texts, dataset_json.opened_groups(texts, ("DM",), chunks)


def _large_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, opened = _taken_apart(spark, sf_dir)
    return dataset_json.domain_table(dataset_json.rows(texts, ("DM",), opened), "DM").select(
        "doc_id", "row_index", "USUBJID", "STUDYID", "RFENDTC")


def _large_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, opened = _taken_apart(spark, sf_dir)
    found = [dataset_json.top_level_findings(texts), dataset_json.group_findings(texts, ("DM",), opened),
             dataset_json.record_findings(texts, ("DM",), opened)]
    return union_findings(found).select("doc_id", "rule_id", "field", "row_index", "evidence")


READERS = {
    "scan_domain": _scan_domain,
    "scan_breaks": _scan_breaks,
    "scan_generic": lambda s, d: files.read_generic(s, docs.generic_csv(s, d)),
    "validate_generic_rules": lambda s, d: pipeline.validate_generic(
        files.read_generic(s, docs.generic_csv(s, d)), outliers=False),
    "scan_json_records": lambda s, d: files.read_json_records(s, docs.record_files(s, d)),
    "dataset_row_counts": _row_counts,
    "log_parse": lambda s, d: logs.read_log(s, docs.log_files(s, d)),
    "log_by_level": lambda s, d: logs.by_level(logs.parse_log(docs.log_lines(s, d)), "error"),
    "findings_documents": lambda s, d: _documents(view(s, d, "findings")),
    "dj_top_level": lambda s, d: dataset_json.top_level_findings(docs.dataset_json(s, d)).select(
        "doc_id", "rule_id", "severity", "field"),
    "dj_gate": lambda s, d: dataset_json.stop_gate(docs.dataset_json(s, d)).select("doc_id"),
    "dj_itemgroups": lambda s, d: dataset_json.item_groups(docs.dataset_json(s, d)),
    "dj_infer_oid": lambda s, d: dataset_json.infer_oids(docs.dataset_json(s, d)),
    "dj_row_findings": lambda s, d: dataset_json.record_findings(docs.dataset_json(s, d)).select(
        "doc_id", "rule_id", "field", "row_index", "evidence"),
    "dj_rows": _dm_rows,
    "dj_large_rows": _large_rows,
    "dj_large_findings": _large_findings,
}
READERS |= {
    "scan_json_list": lambda s, d: files.read_json_records(s, docs.mixed_record_files(s, d, True)),
    "scan_json_mixed": lambda s, d: files.read_json_records(s, docs.mixed_record_files(s, d, False)),
    "dj_group_findings": lambda s, d: dataset_json.group_findings(docs.faulty_groups(s, d), ("DM", "AE")).select(
        "doc_id", "rule_id", "field", "message", "evidence"),
    "dj_envelopes": lambda s, d: dataset_json.domain_table(
        dataset_json.rows(dataset_json.unwrap_envelopes(docs.envelopes(s, d)), ("DM",)), "DM", docs.DM_COLUMNS).drop("_columns"),
    "edc_form_list": lambda s, d: form_export.forms(docs.form_metadata(s, d)),
    "edc_fields": lambda s, d: form_export.form_fields(docs.form_metadata(s, d), "FORM_2"),
    "edc_all_forms": lambda s, d: form_export.forms(docs.part_metadata(s, d)),
    "edc_all_fields": lambda s, d: form_export.all_form_fields(docs.part_metadata(s, d)),
    "edc_projects_metadata": lambda s, d: form_export.projects_metadata(
        docs.project_listing(s, d), base(s, d, "orders").select(F.col("o_custkey").cast("string").alias("study_id"))),
    "edc_project_metadata": lambda s, d: form_export.project_metadata(docs.project_listing(s, d), "7"),
    "parquet_positions": lambda s, d: rowid.with_parquet_row_index(base(s, d, "orders").select("o_orderkey", "o_custkey")),
}
for _name, _reader in READERS.items():
    register(_name, _reader, st.SQL_SOURCES[_name])

register("validate_generic", lambda s, d: pipeline.validate_generic(files.read_generic(s, docs.generic_csv(s, d))))
register("dj_validate", lambda s, d: dataset_json.validate_documents(docs.dataset_json(s, d)), documents_sql())
register("edc_flatten", lambda s, d: form_export.flatten(
    docs.form_metadata(s, d), docs.form_records(s, d), "FORM_2").select(
        "record_id", *[F.array_join(c, "|").alias(c) for c in ("columns", "values")]), st.SQL_SOURCES["edc_flatten"])
register("edc_forms", lambda s, d: form_export.subjects(docs.form_records(s, d)), st.SQL_SOURCES["edc_forms"])
register("edc_projects", lambda s, d: form_export.projects(docs.project_listing(s, d)), st.SQL_SOURCES["edc_projects"])
register("dataset_sample", lambda s, d: analytics.dataset_sample(view(s, d, "ae")),
         f"WITH {o.domain_cte('ae')} SELECT row_id AS row_index, * EXCLUDE (row_id) FROM ae ORDER BY row_id LIMIT 5")


# --- whole jobs over many studies, and the outlier cut ---------------------------------------------------

def _job_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three studies that share subjects, one of them without vital signs and disposition events."""
    tables = {}
    for code, df in domains(spark, sf_dir).items():
        study = F.expr(STUDY_OF[code.lower()].replace("row_id", "row_index"))
        tables[code] = df.drop("STUDYID").withColumn("STUDYID", F.concat(F.lit("ST"), study.cast("string")))
    return tables


def _validate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.validate_job(_job_tables(spark, sf_dir), ("STUDYID",), outliers=False).drop("row_index")


def _job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.validate_job(_job_tables(spark, sf_dir), ("STUDYID",))
    return found.groupBy("STUDYID", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def _outliers_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects dealt to 61 studies and one without a name."""
    frame = features.flagged_features(_frame_domains(spark, sf_dir))
    studies = frame.withColumn("STUDYID", F.when(F.col("row_index") % 62 > 0, F.concat(F.lit("ST"), (F.col("row_index") % 62).cast("string"))))
    found = outliers.detect_study_outliers(scratch.written(studies), ("STUDYID",))
    return found.groupBy("STUDYID").agg(F.count(F.lit(1)).alias("rows"), F.sum("anomaly").alias("flagged"))


def _outlier_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether as many rows are flagged as the cut wants."""
    allowed = F.ceil(F.lit(outliers.CONTAMINATION) * (F.count(F.lit(1)) - 1))
    return _outlier_frame(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), allowed.alias("allowed"),
        (F.sum("anomaly") == allowed).alias("fits"))


def _counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def _run_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job, run twice as after a lost worker: files read, validated, findings stored, and the store read back."""
    path, uploads = scratch.new_path(spark, "store"), docs.uploads(spark, sf_dir)
    for _ in range(2):
        pipeline.run_job(spark, uploads, path, tenant_id="T", job_id="J", study_id="S")
    return _counts(sinks.findings_store(path).read(spark))


def _stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of four jobs, two of which run again and find less, or nothing."""
    found, path = view(spark, sf_dir, "findings"), scratch.new_path(spark, "store")
    for job, keep in (("J1", "true"), ("J2", "true"), ("J3", "true"), ("J4", "true"), ("J2", "id % 2 = 0"), ("J3", "false")):
        sinks.store_findings(found.where(f"job_id = '{job}' AND {keep}"), path, "7", job, "01")
    return sinks.findings_store(path).read(spark).drop("created_at")


def _changed_store(table: str, requests: str, by: tuple[str, ...], apply: Callable[[DataFrame, DataFrame], DataFrame],
                   columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """A table stored, changed in place, and read back."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, asked = view(spark, sf_dir, table), view(spark, sf_dir, requests)
        stored = store.Store(scratch.new_path(spark, "store"), rows.schema, by)
        stored.replace(rows)
        stored.change(asked, lambda own: apply(own, asked))
        return stored.read(spark).select(*columns)
    return build


register("run_job", _run_job, st.SQL_SOURCES["validate_all_counts"])
register("findings_stored_once", _stored_once, st.SQL_SOURCES["findings_stored_once"])
register("store_resolutions", _changed_store(
    "findings", "requests", ("tenant_id", "study_id", "job_id"), changes.apply_resolutions,
    ("id", "status", "resolved_by", "resolved_at", "resolution_note")), st.SQL["apply_resolutions"])
register("store_soft_delete", _changed_store(
    "studies", "study_edits", ("tenant_id",), lambda own, edits: changes.soft_delete(own, "id", edits), ("id", "status")), st.SQL["soft_delete"])
register("store_partial_update", _changed_store(
    "studies", "study_edits", ("tenant_id",), lambda own, edits: changes.partial_update(own, "id", edits),
    ("id", "title", "phase", "sponsor")), st.SQL["partial_update"])
register("validate_all_counts", lambda s, d: _counts(pipeline.validate_all(domains(s, d))), st.SQL_SOURCES["validate_all_counts"])
register("validate_generic_counts", lambda s, d: _counts(pipeline.validate_generic(files.read_generic(s, docs.generic_csv(s, d)))),
         st.SQL_SOURCES["validate_generic_counts"])
register("validate_job", _validate_job, st.SQL_SOURCES["validate_job"])
register("validate_job_counts", _job_counts, st.SQL_SOURCES["validate_job_counts"])
register("anomaly_by_study", _outliers_by_study, st.SQL_SOURCES["anomaly_by_study"])
register("anomaly_count_invariant", _outlier_share, st.SQL_SOURCES["anomaly_count_invariant"])
