"""DuckDB SQL for listings, reports, changes, scalar functions and windows."""

from __future__ import annotations

from fixtures.oracle_cross import FEATURE_SQL, FRAME_DOMAINS, all_rules_sql, frame_select
from fixtures.oracle_rules import BLANK, D, K, N, domain_cte
from fixtures.store_views import STORE_VIEWS
from fixtures.views import DOMAIN_VIEWS, STUDY_OF

RANK = "CASE severity WHEN 'CRIT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MED' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
COUNTS = ("count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS \"{s}\"" for s in ("CRIT", "HIGH", "MED", "LOW")))
DOMAIN_TEXT = ("SELECT job_id, string_agg(domain || '=' || CAST(n AS STRING), ';' ORDER BY domain) AS domains "
               "FROM (SELECT job_id, domain, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1")


def store(sql: str, *names: str, extra: str = "") -> str:
    ctes = [f"{n} AS ({STORE_VIEWS[n]})" for n in names]
    return f"WITH {', '.join(ctes)}{extra} {sql}"


def shorten(limit: int, c: str = "message") -> str:
    marker = "' (found: '"
    cut = f"length({c}) - strpos(reverse({c}), reverse({marker})) + 1 - length({marker})"
    tail = f"substr({c}, {cut} + 1)"
    return (f"CASE WHEN length({c}) <= {limit} THEN {c} "
            f"WHEN strpos({c}, {marker}) = 0 THEN rtrim(left({c}, {limit})) || '…' "
            f"ELSE rtrim(left({c}, greatest({limit} - length({tail}), 20))) || '…' || {tail} END")


def hashed(columns: list[str]) -> str:
    parts = []
    for c in sorted(columns):
        text = f"coalesce(CAST({c} AS STRING), 'None')"
        parts.append(f"'{c}={{' || CAST(length({text}) AS STRING) || '}}' || {text}")
    return f"sha256({' || '.join(parts)})"


STUDY_CONTENT = ["id", "tenant_id", "study_id", "title", "phase", "sponsor", "therapeutic_area", "status"]
CHOSEN = ("chosen AS (SELECT id, request_id, new_status, user_id, requested_at, note FROM requests "
          "WHERE new_status IN ('resolved', 'waived') "
          "QUALIFY row_number() OVER (PARTITION BY id ORDER BY requested_at, request_id) = 1)")
LATEST_JOB = ("latest AS (SELECT * FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER "
              "(PARTITION BY tenant_id, study_id ORDER BY completed_at DESC, job_id DESC) = 1)")

SQL = {
    "list_findings": store(
        "SELECT * FROM findings WHERE tenant_id = 'T1' AND domain = 'AE' AND status = 'open' "
        f"ORDER BY {RANK}, created_at, id LIMIT 100 OFFSET 20", "findings"),
    "report_order": store(
        f"SELECT row_number() OVER (ORDER BY domain NULLS FIRST, {RANK}, row_index NULLS FIRST, id) - 1 AS position, id, domain, severity, "
        "row_index FROM findings", "findings"),
    "report_detail": store(
        "SELECT domain, rule_id, severity, field, left(coalesce(evidence, ''), 120) AS value, "
        f"{shorten(200)} AS message FROM (SELECT * FROM findings ORDER BY domain, {RANK}, row_index, id LIMIT 200)",
        "findings"),
    "report_summary": store(f"SELECT job_id, {COUNTS} FROM findings GROUP BY job_id", "findings"),
    "report_text_lines": store(
        "SELECT id, '[' || severity || '] ' || domain || ' | ' || rule_id || ' | ' || field || '=' || "
        "coalesce(evidence, '') || ' | ' || message AS line FROM findings", "findings"),
    "report_header": store(
        "SELECT j.tenant_id, j.study_id, j.job_id, j.status, coalesce(t.name, j.tenant_id) AS tenant_name, s.title, "
        "s.phase, s.sponsor, s.therapeutic_area FROM jobs j LEFT JOIN tenants t USING (tenant_id) "
        "LEFT JOIN known_studies s ON s.tenant_id = j.tenant_id AND s.study_id = j.study_id",
        "jobs", "tenants", "known_studies"),
    "top_findings_per_job": store(
        "SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY "
        f"{RANK}, domain, rule_id, row_index, id) AS position, id, rule_id, severity, domain, field, message, usubjid "
        "FROM findings WHERE severity IN ('CRIT', 'HIGH') QUALIFY position <= 30", "findings"),
    "query_context": store(
        f"SELECT study_id, job_id, {COUNTS} FROM (SELECT f.severity, l.study_id, f.job_id, row_number() OVER "
        "(PARTITION BY f.job_id ORDER BY f.id) AS n FROM findings f JOIN latest l USING (job_id)) "
        "WHERE n <= 50 GROUP BY 1, 2", "findings", "finding_jobs",
        extra=", " + LATEST_JOB.replace("FROM jobs", "FROM finding_jobs")),
    "job_context": store(
        "SELECT j.tenant_id, j.study_id, j.job_id, coalesce(c.total, 0) AS total, coalesce(c.\"CRIT\", 0) AS \"CRIT\", "
        "coalesce(c.\"HIGH\", 0) AS \"HIGH\", coalesce(c.\"MED\", 0) AS \"MED\", coalesce(c.\"LOW\", 0) AS \"LOW\", "
        "d.domains, s.title, s.phase, s.sponsor, s.therapeutic_area FROM jobs j "
        f"LEFT JOIN (SELECT job_id, {COUNTS} FROM findings GROUP BY 1) c USING (job_id) "
        f"LEFT JOIN ({DOMAIN_TEXT}) d USING (job_id) LEFT JOIN known_studies s "
        "ON s.tenant_id = j.tenant_id AND s.study_id = j.study_id WHERE j.status = 'completed'",
        "findings", "jobs", "known_studies"),
    "summary_domain_map": store(DOMAIN_TEXT, "findings"),
    "kpi_status": store(
        "SELECT (SELECT count(*) FROM studies WHERE status = 'active') AS active_studies, "
        "(SELECT count(*) FROM studies WHERE status = 'archived') AS archived_studies, "
        "count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') "
        "AS failed_jobs FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 10)", "studies", "jobs"),
    "unique_study": store("SELECT tenant_id, study_id, count(*) AS copies FROM studies GROUP BY 1, 2 "
                          "HAVING count(*) > 1", "studies"),
    "latest_job_per_study": store("SELECT tenant_id, study_id, job_id, completed_at FROM latest", "jobs",
                                  extra=f", {LATEST_JOB}"),
    "latest_dataset_per_study": store(
        "SELECT tenant_id, study_id, dataset_id, created_at FROM datasets QUALIFY row_number() OVER "
        "(PARTITION BY tenant_id, study_id ORDER BY created_at DESC, dataset_id DESC) = 1", "datasets"),
    "latest_per_domain": store(
        "SELECT tenant_id, study_id, domain, dataset_id, created_at FROM datasets QUALIFY row_number() OVER "
        "(PARTITION BY tenant_id, study_id, domain ORDER BY created_at DESC, dataset_id DESC) = 1", "datasets"),
    "list_audit": store(
        "SELECT * FROM audit WHERE action ILIKE '%FINDINGS%' AND occurred_at >= TIMESTAMP '2024-01-05 00:00:00' "
        "AND occurred_at <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY occurred_at DESC, id LIMIT 50 OFFSET 10", "audit"),
    "list_latest": store(
        "SELECT row_number() OVER (ORDER BY created_at DESC, job_id) - 1 AS position, job_id, study_id, status, created_at FROM jobs", "jobs"),
    "list_latest_page": store(
        "SELECT job_id, study_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100", "jobs"),
    "selectable_studies": store("SELECT id, status FROM studies WHERE status <> 'archived'", "studies"),
    "reportable_jobs": store("SELECT job_id, status FROM jobs WHERE status = 'completed'", "jobs"),
    "tenant_scope": store("SELECT id, tenant_id FROM findings WHERE tenant_id = 'T2'", "findings"),
    "job_datasets": store(
        "SELECT j.tenant_id, j.job_id, j.dataset_id, d.study_id, d.domain FROM (SELECT tenant_id, job_id, "
        "unnest(dataset_ids) AS dataset_id FROM jobs) j JOIN datasets d ON d.tenant_id = j.tenant_id "
        "AND d.dataset_id = j.dataset_id", "jobs", "datasets"),
    "job_duration": store(
        "SELECT job_id, round(epoch_us(completed_at - started_at) / 1000000.0, 1) AS duration_s FROM jobs"
        .replace("epoch_us(completed_at - started_at)", "(epoch_us(completed_at) - epoch_us(started_at))"), "jobs"),
    "apply_rule_profile": store(
        "SELECT f.id, f.rule_id, coalesce(o.severity, f.severity) AS severity FROM findings f LEFT JOIN overrides o "
        "ON o.tenant_id = f.tenant_id AND o.rule_id = f.rule_id WHERE coalesce(o.enabled, true)",
        "findings", "overrides"),
    "apply_resolutions": store(
        "SELECT f.id, CASE WHEN f.status = 'open' AND c.id IS NOT NULL THEN c.new_status ELSE f.status END AS status, "
        "CASE WHEN f.status = 'open' AND c.id IS NOT NULL THEN c.user_id ELSE f.resolved_by END AS resolved_by, "
        "CASE WHEN f.status = 'open' AND c.id IS NOT NULL THEN c.requested_at ELSE f.resolved_at END AS resolved_at, "
        "CASE WHEN f.status = 'open' AND c.id IS NOT NULL THEN c.note ELSE f.resolution_note END AS resolution_note "
        "FROM findings f LEFT JOIN chosen c USING (id)", "findings", "requests", extra=f", {CHOSEN}"),
    "resolution_rejects": store(
        "SELECT * FROM (SELECT r.request_id, r.id, r.new_status, CASE WHEN r.new_status NOT IN ('resolved', 'waived') "
        "THEN 'status must be ''resolved'' or ''waived''.' WHEN f.id IS NULL THEN 'Finding not found.' "
        "WHEN f.status <> 'open' THEN 'Finding is already ''' || f.status || '''.' WHEN c.id IS NULL THEN "
        "'Finding is already closed by an earlier request.' END AS reason FROM requests r LEFT JOIN findings f "
        "ON f.id = r.id LEFT JOIN chosen c ON c.id = r.id AND c.request_id = r.request_id) WHERE reason IS NOT NULL",
        "findings", "requests", extra=f", {CHOSEN}"),
    "soft_delete": store(
        "SELECT id, CASE WHEN id IN (SELECT id FROM study_edits) THEN 'archived' ELSE status END AS status FROM studies",
        "studies", "study_edits"),
    "partial_update": store(
        "SELECT s.id, coalesce(e.title, s.title) AS title, coalesce(e.phase, s.phase) AS phase, s.sponsor FROM studies s "
        "LEFT JOIN study_edits e USING (id)", "studies", "study_edits"),
    "row_hash": store(f"SELECT id, {hashed(STUDY_CONTENT)} AS hash FROM studies", "studies"),
    "audit_diff": store(
        "SELECT CASE WHEN o.id IS NULL THEN 'studies.create' WHEN n.id IS NULL THEN 'studies.delete' "
        "ELSE 'studies.update' END AS action, coalesce(o.id, n.id) AS target_id, "
        "CASE WHEN n.id IS NULL THEN o.h ELSE '' END AS before_hash, coalesce(n.h, '') AS after_hash "
        f"FROM (SELECT id, {hashed(STUDY_CONTENT)} AS h FROM studies) o FULL OUTER JOIN "
        f"(SELECT id, {hashed(STUDY_CONTENT)} AS h FROM studies_after) n ON o.id = n.id "
        "WHERE o.h IS DISTINCT FROM n.h", "studies", "studies_after"),
    "findings_persist_shape": store(
        "SELECT 'T1' AS tenant_id, 'J1' AS job_id, 'ST1' AS study_id, finding_type, rule_id, severity, domain, field, "
        "message, row_index, nullif(usubjid, '') AS usubjid, nullif(evidence, '') AS evidence, 'open' AS status "
        "FROM findings", "findings"),
    "fn_truncate_message": store(
        f"SELECT id, {shorten(90)} AS short_90, {shorten(200)} AS short_200 FROM findings", "findings"),
    "detect_format": store(
        "SELECT dataset_id, fmt AS format, fmt IN ('csv', 'json', 'dataset-json') AS allowed FROM (SELECT dataset_id, "
        "lower(coalesce(given_format, CASE WHEN lower(filename) LIKE '%.csv' THEN 'csv' ELSE 'json' END)) AS fmt "
        "FROM datasets)", "datasets"),
    "replay_row_index": (
        f"WITH {domain_cte('dm', 'ae')} SELECT 'X_DMLINK_AE_001' AS rule_id, row_id AS source_row, row_number() OVER "
        f"(ORDER BY row_id) - 1 AS row_index FROM ae WHERE {K('USUBJID')} <> '' AND {K('USUBJID')} NOT IN "
        f"(SELECT {K('USUBJID')} FROM dm)"),
    # scalar functions
    "fn_clean": f"WITH {domain_cte('ex')} SELECT row_id AS row_index, {K('EXROUTE')} AS route, {K('EXTRT')} AS trt FROM ex",
    "fn_blank": f"WITH {domain_cte('ds')} SELECT row_id AS row_index, {BLANK('DSTERM')} AS term_blank, "
                f"{BLANK('USUBJID')} AS subject_blank FROM ds",
    "fn_num": f"WITH {domain_cte('ex')} SELECT row_id AS row_index, {N('EXDOSE')} AS dose FROM ex",
    "fn_num_comma": f"WITH {domain_cte('vs')} SELECT VSORRES, "
                    f"{N('d')} AS result FROM (SELECT VSORRES, replace(VSORRES, ',', '.') AS d FROM vs)",
    "fn_iso_date": f"WITH {domain_cte('dm')} SELECT row_id AS row_index, {D('RFSTDTC')} AS rf_start, "
                   f"{D('RFENDTC')} AS rf_end FROM dm",
    "fn_message": f"WITH {domain_cte('dm')} SELECT row_id AS row_index, 'Checked.' || CASE WHEN coalesce(SEX, '') = '' "
                  "THEN '' ELSE ' (found: ''' || SEX || ''')' END AS message FROM dm",
    "fn_feature_evidence": (
        f"WITH {domain_cte('dm')} SELECT row_id AS row_index, concat_ws(', ', CASE WHEN {N('AGE')} IS NOT NULL "
        f"THEN 'AGE=' || CAST(CAST({N('AGE')} AS BIGINT) AS STRING) END, CASE WHEN row_id % 3 > 0 THEN 'PR_COUNT=' || "
        "CAST(row_id % 3 AS STRING) END) AS evidence FROM dm"),
    "apply_rules": (
        f"WITH {domain_cte(*FRAME_DOMAINS)}, frame AS ({frame_select()}) SELECT row_index, "
        "CAST(coalesce(AGE BETWEEN 18 AND 120, false) AS INT) AS \"AGE_valid\", "
        "CAST(coalesce(SYSBP BETWEEN 90 AND 180, false) AS INT) AS \"SYSBP_valid\", "
        "CAST(coalesce(DOSE >= 0.001, false) AS INT) AS \"DOSE_valid\", "
        "CAST(VSDTC IS NOT NULL AS INT) AS date_valid FROM frame"),
    "impute_medians": (
        f"WITH {domain_cte(*FRAME_DOMAINS)}, frame AS ({frame_select()}) SELECT row_index, " + ", ".join(
            f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM frame), 0) AS {c}"
            for c in ["AGE", *[f for f in FEATURE_SQL if f != 'VSDTC']]) + " FROM frame"),
    "vocab_pair_lookup": (
        f"WITH {domain_cte('vs')}, pairs AS (SELECT DISTINCT {K('VSTESTCD')} AS test, {K('VSORRESU')} AS unit FROM vs "
        f"WHERE {K('VSORRESU')} <> 'sec') SELECT test, unit, count(*) AS n FROM (SELECT {K('VSTESTCD')} AS test, "
        f"{K('VSORRESU')} AS unit FROM vs WHERE VSORRESU IS NOT NULL) v WHERE test IN (SELECT test FROM pairs) AND "
        "NOT EXISTS (SELECT 1 FROM pairs p WHERE p.test = v.test AND p.unit = v.unit) GROUP BY 1, 2"),
    # summaries over all rule findings
    "union_findings": f"{all_rules_sql()} SELECT rule_id, count(*) AS n FROM all_findings GROUP BY 1",
    "summary_by_severity": f"{all_rules_sql()} SELECT {COUNTS} FROM all_findings",
    "summary_by_domain": f"{all_rules_sql()} SELECT domain, count(*) AS findings, row_number() OVER "
                         "(ORDER BY count(*) DESC, domain) - 1 AS position FROM all_findings GROUP BY 1",
    # windows
    "failed_login_windows": (
        "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' "
        "AS window_end, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 50"),
    "error_rate_windows": (
        "SELECT w AS window_start, w + INTERVAL '60 seconds' AS window_end, failures, requests, failures / 60.0 AS "
        "failures_per_second, failures / requests AS failure_share, failures / 60.0 > 0.05 AS alert FROM "
        "(SELECT time_bucket(INTERVAL '60 seconds', ts) AS w, count(*) FILTER (WHERE event_type = 'error') AS failures, "
        "count(*) AS requests FROM events GROUP BY 1)"),
    "p99_windows": (
        "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL "
        "'1 hour' AS window_end, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.99) > 200 AS alert "
        "FROM events GROUP BY 1, 2"),
}

_NULL = "('', 'nan', 'NULL', 'n/a', 'NA', 'N/A', 'None', 'NaN', 'null')"
_AE_NULLED = ", ".join(f"CASE WHEN {c} NOT IN {_NULL} THEN {c} END AS {c}"
                       for c in ("USUBJID", "AETERM", "AESTDTC", "AEENDTC", "AESER", "AESEV"))
_LOG = ("SELECT date_trunc('second', ts) AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN "
        "'WARNING' ELSE 'INFO' END AS level, 'event ' || CAST(event_id AS STRING) || ' by user ' || "
        "CAST(user_id AS STRING) AS message FROM events WHERE event_id % 10 <> 7")
DOCS = ("docs AS (SELECT DISTINCT c_custkey // 100 AS doc FROM customer), tops AS (SELECT doc, CASE WHEN doc % 7 = 6 "
         "THEN 'DJ_001' WHEN doc % 11 = 5 THEN 'DJ_002' WHEN doc % 13 = 4 THEN 'DJ_002b' WHEN doc % 17 = 3 THEN "
         "'DJ_003' WHEN doc % 19 = 2 THEN 'DJ_004' END AS rule FROM docs)")
GOOD_DOCS = "(SELECT doc FROM tops WHERE rule IS NULL)"
RECORDS = " UNION ALL ".join(
    f"SELECT doc, '{code}' AS domain, '{oid}' AS oid, row_number() OVER (PARTITION BY doc ORDER BY row_id) - 1 AS n, "
    f"row_id % 77 = 5 AS broken, row_id % 50 = 3 AS short, {width} AS width FROM (SELECT *, row_id // {per} AS doc "
    f"FROM {view}) WHERE doc IN {GOOD_DOCS}"
    for code, oid, width, per, view in (("DM", "IG.ONE", 7, 100, "dm"), ("AE", "IG.AE", 6, 1000, "ae")))


def sources_sql() -> dict[str, str]:
    from fixtures.documents import GENERIC
    generic = (f"WITH g AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_index, PATIENT_ID, "
               + ", ".join(f"CASE WHEN {c} NOT IN {_NULL} THEN {c} END AS {c}" for c in ("AGE", "SYSBP", "VSDTC", "DOSE"))
               + f" FROM ({GENERIC}))")
    flags = []
    for name, test in (("AGE", f"{N('AGE')} BETWEEN 18 AND 120"), ("SYSBP", f"{N('SYSBP')} BETWEEN 90 AND 180"),
                       ("DOSE", f"{N('DOSE')} >= 0.001")):
        flags.append((name, f"NOT coalesce({test}, false)", f"coalesce({name}, '')"))
    flags.append(("date", "VSDTC IS NULL", "''"))
    validated = " UNION ALL ".join(
        f"SELECT 'SDTM_RULE' AS finding_type, 'GENERIC_{n.upper()}_001' AS rule_id, 'MED' AS severity, 'GENERAL' AS "
        f"domain, '{n}' AS field, '{n} failed validation rule.' || CASE WHEN ev = '' THEN '' ELSE ' (found: ''' || ev "
        f"|| ''')' END AS message, row_index, '' AS usubjid, ev AS evidence FROM (SELECT *, {ev} AS ev FROM g WHERE {w})"
        for n, w, ev in flags)
    return {
        "scan_domain": f"WITH {domain_cte('ae')} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_index, "
                       f"{_AE_NULLED} FROM ae",
        "scan_generic": f"{generic} SELECT * FROM g",
        "validate_generic_rules": f"{generic} {validated}",
        "scan_json_records": f"WITH {domain_cte('dm')} SELECT CAST(row_id AS STRING) AS SEQ, row_number() OVER (PARTITION BY row_id // 100 ORDER BY row_id) - 1 AS row_index, USUBJID, SEX, AGE FROM dm",
        "dataset_row_counts": f"WITH {domain_cte('dm')} SELECT STUDYID AS dataset, count(*) AS row_count FROM dm GROUP BY 1",
        "log_parse": _LOG,
        "log_by_level": f"SELECT * FROM ({_LOG}) WHERE level = 'ERROR'",
        "findings_documents": store(
            "SELECT id, rule_id, evidence, created_at FROM findings", "findings"),
        "dj_top_level": (
            f"WITH {DOCS} SELECT CAST(doc AS STRING) AS doc_id, rule AS rule_id, 'CRIT' AS severity, "
            "CASE rule WHEN 'DJ_001' THEN 'root' WHEN 'DJ_002' THEN 'clinicalData/referenceData' WHEN 'DJ_002b' THEN "
            "'clinicalData' ELSE 'itemGroupData' END AS field FROM tops WHERE rule IS NOT NULL"),
        "dj_gate": f"WITH {DOCS} SELECT CAST(doc AS STRING) AS doc_id FROM tops WHERE rule IS NULL",
        "dj_itemgroups": (
            f"WITH {DOCS} SELECT CAST(doc AS STRING) AS doc_id, p AS position, CASE p WHEN 0 THEN 'IG.AE' ELSE "
            "'IG.ONE' END AS oid FROM tops, (VALUES (0), (1)) v(p) WHERE rule IS NULL"),
        "dj_infer_oid": (
            f"WITH {DOCS} SELECT CAST(doc AS STRING) AS doc_id, domain, CASE WHEN rule IS NULL THEN o END AS oid FROM tops, "
            "(VALUES ('DM', 'IG.ONE'), ('VS', NULL), ('AE', 'IG.AE'), ('CM', NULL)) v(domain, o)"),
        "dj_row_findings": (
            f"WITH {domain_cte('dm', 'ae')}, {DOCS} SELECT CAST(doc AS STRING) AS doc_id, CASE WHEN broken THEN 'DJ_105' "
            "ELSE 'DJ_106' END AS rule_id, oid || '.itemData[' || CAST(n AS STRING) || ']' AS field, n AS row_index, CASE "
            "WHEN broken THEN '' ELSE 'got ' || CAST(width - 1 AS STRING) || ', expected ' || CAST(width AS STRING) END AS "
            f"evidence FROM ({RECORDS}) WHERE broken OR short"),
        "dj_rows": (
            f"WITH {domain_cte('dm')}, {DOCS} SELECT CAST(doc AS STRING) AS doc_id, row_number() OVER (PARTITION BY doc "
            "ORDER BY row_id) - 1 AS row_index, USUBJID, STUDYID, CASE WHEN row_id % 50 <> 3 THEN RFENDTC END AS RFENDTC "
            f"FROM (SELECT *, row_id // 100 AS doc FROM dm) WHERE row_id % 77 <> 5 AND doc IN {GOOD_DOCS}"),
    }


_NATION_VALUE = (
    "CASE WHEN n.n_nationkey = c.c_nationkey THEN c.c_mktsegment WHEN n.n_nationkey = (c.c_nationkey + 1) % 25 "
    "THEN c.c_name ELSE '' END")
def job_sql() -> str:
    """All rules over the rows of each study on its own."""
    parts = []
    for study in range(3):
        sql = all_rules_sql()
        for name, given in DOMAIN_VIEWS.items():
            columns = f"* REPLACE ('ST{study}' AS STUDYID)" if name == "dm" else "*"
            whole = f"{name} AS ({given})"
            assert whole in sql, name
            sql = sql.replace(whole, f"{name} AS (SELECT {columns} FROM ({given}) given WHERE {STUDY_OF[name]} = {study})")
        # Nothing is an orphan of a table without rows, as vital signs are in study 2.
        kept = "rule_id NOT IN ('X_VSAE_001', 'X_VSCM_001')" if study == 2 else "true"
        parts.append(f"SELECT *, 'ST{study}' AS \"STUDYID\" FROM ({sql} SELECT * FROM all_findings WHERE {kept}) study{study}")
    return " UNION ALL ".join(parts)


_RECORDS_SQL = f"WITH {domain_cte('dm')} SELECT CAST(row_id AS STRING) AS SEQ, (row_number() OVER (PARTITION BY row_id // 100 ORDER BY row_id)) - 1 AS row_index, USUBJID, SEX, AGE FROM dm"
_DOC_NUMBERS = "(SELECT DISTINCT c_custkey // 100 AS doc FROM customer)"
_RANK = "CASE severity WHEN 'CRIT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MED' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
SQL_SOURCES = sources_sql() | {
    "audit_stream": store(
        f"SELECT 'studies.create' AS action, CAST(id AS VARCHAR) AS target_id, '' AS before_hash, {hashed(STUDY_CONTENT)} AS after_hash FROM studies "
        f"UNION ALL SELECT action, CAST(target_id AS VARCHAR), before_hash, after_hash FROM ({SQL['audit_diff']}) d", "studies"),
    "summary_kept_up": store("SELECT tenant_id, job_id, domain, count(*) AS findings FROM findings GROUP BY 1, 2, 3", "findings"),
    "deep_page_findings": store(
        f"SELECT position, id, severity, created_at FROM (SELECT *, row_number() OVER (ORDER BY {_RANK}, created_at, id) - 1 AS position "
        "FROM findings WHERE tenant_id = 'T1') f WHERE position BETWEEN 2950 AND 3049", "findings"),
    "deep_page_jobs": store(
        "SELECT position, job_id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id) - 1 AS position FROM jobs) j "
        "WHERE position BETWEEN 9990 AND 10009", "jobs"),
    "dj_large_rows": (
        f"WITH {domain_cte('dm')} SELECT CAST(row_id // 5000 AS STRING) AS doc_id, row_number() OVER (PARTITION BY row_id // 5000 "
        "ORDER BY row_id) - 1 AS row_index, USUBJID, STUDYID, CASE WHEN row_id % 50 <> 3 THEN RFENDTC END AS RFENDTC FROM dm WHERE row_id % 77 <> 5"),
    "dj_large_findings": (
        f"WITH {domain_cte('dm')} SELECT doc_id, CASE WHEN row_id % 77 = 5 THEN 'DJ_105' ELSE 'DJ_106' END AS rule_id, "
        "'IG.DM.itemData[' || CAST(row_index AS STRING) || ']' AS field, row_index, CASE WHEN row_id % 77 = 5 THEN '' ELSE 'got 6, expected 7' END AS evidence "
        "FROM (SELECT row_id, CAST(row_id // 5000 AS STRING) AS doc_id, row_number() OVER (PARTITION BY row_id // 5000 ORDER BY row_id) - 1 AS row_index FROM dm) d "
        "WHERE row_id % 77 = 5 OR row_id % 50 = 3"),
    "findings_stored_once": store(
        "SELECT '7' AS tenant_id, job_id, '01' AS study_id, finding_type, rule_id, severity, domain, field, message, row_index, "
        "nullif(usubjid, '') AS usubjid, nullif(evidence, '') AS evidence, 'open' AS status "
        "FROM findings WHERE job_id IN ('J1', 'J4') OR (job_id = 'J2' AND id % 2 = 0)", "findings"),
    "scan_breaks": (
        "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id::VARCHAR AS doc_id, lang, nullif(text, '') AS text, source FROM documents"),
    "scan_json_list": _RECORDS_SQL,
    "scan_json_mixed": _RECORDS_SQL,
    "dj_group_findings": (
        "SELECT CAST(doc AS STRING) AS doc_id, CASE doc % 5 WHEN 1 THEN 'DJ_100' WHEN 2 THEN 'DJ_101' WHEN 3 THEN 'DJ_102' ELSE 'DJ_104' END AS rule_id, "
        "CASE doc % 5 WHEN 1 THEN 'itemGroupData' WHEN 3 THEN 'IG.DM.itemData' ELSE 'IG.DM.items' END AS field, "
        "CASE doc % 5 WHEN 1 THEN 'OID ''IG.DM'' not found.' WHEN 2 THEN 'Non-empty ''items'' array required.' "
        "WHEN 3 THEN '''itemData'' must be an array.' ELSE 'Could not derive column names.' END AS message, '' AS evidence "
        f"FROM {_DOC_NUMBERS} d WHERE doc % 5 > 0 UNION ALL SELECT CAST(doc AS STRING), 'DJ_110', 'domain', "
        f"'Could not infer OID for domain ''AE''.', 'IG.DM' FROM {_DOC_NUMBERS} d"),
    "dj_envelopes": (
        f"WITH {domain_cte('dm')} SELECT CAST(row_id // 100 AS STRING) AS doc_id, "
        "row_number() OVER (PARTITION BY row_id // 100 ORDER BY row_id) - 1 AS row_index, USUBJID, STUDYID, SEX, AGE, AGEU, RFSTDTC, RFENDTC FROM dm"),
    "edc_form_list": "SELECT DISTINCT 'FORM_' || n_regionkey AS form FROM nation",
    "edc_fields": (
        "SELECT n_nationkey AS position, 'IT.FORM_2.' || nm AS \"itemOID\", nm AS name, CASE n_nationkey % 5 WHEN 2 THEN 'float' WHEN 3 THEN 'integer' ELSE 'string' END "
        "AS \"dataType\", n_name AS label, CASE n_nationkey % 5 WHEN 1 THEN 4000 WHEN 2 THEN 20 ELSE 200 END AS length FROM "
        "(SELECT *, upper('f_' || regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) AS nm FROM nation) n WHERE n_regionkey = 2"),
    "edc_all_forms": "SELECT DISTINCT CASE WHEN p_partkey % 37 > 0 THEN 'FORM_' || (p_partkey // 20) ELSE 'UNKNOWN' END AS form FROM part",
    "edc_all_fields": (
        "SELECT form, position, 'IT.' || form || '.' || name AS \"itemOID\", name, CASE WHEN kind = 'calc' THEN 'float' WHEN kind = 'Slider' THEN 'integer' "
        "ELSE 'string' END AS \"dataType\", label, CASE kind WHEN 'notes' THEN 4000 WHEN 'calc' THEN 20 ELSE 200 END AS length FROM ("
        "SELECT p_partkey AS position, 'F_' || p_partkey AS name, CASE WHEN p_partkey % 37 > 0 THEN 'FORM_' || (p_partkey // 20) ELSE 'UNKNOWN' END AS form, "
        "CASE WHEN p_partkey % 11 > 0 THEN ['text', 'notes', 'calc', 'Slider', 'radio'][p_partkey % 5 + 1] ELSE 'text' END AS kind, "
        "CASE WHEN p_partkey % 13 > 0 THEN p_name ELSE '' END AS label FROM part) p"),
    "edc_projects_metadata": (
        "SELECT CAST(c_custkey AS STRING) AS study_id, c_name AS title, ' ' AS sponsor, '' AS protocol_id, '' AS start_date, 'active' AS status "
        "FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "edc_project_metadata": (
        "SELECT CAST(c_custkey AS STRING) AS study_id, c_name AS title, ' ' AS sponsor, '' AS protocol_id, '' AS start_date, 'active' AS status "
        "FROM customer WHERE c_custkey = 7"),
    "parquet_positions": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
    "edc_forms": "SELECT CAST(c_custkey AS STRING) AS usubjid, '' AS siteid FROM customer",
    "edc_projects": (
        "SELECT CAST(c_custkey AS STRING) AS study_id, c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN 'active' ELSE "
        "'unknown' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'other purpose' ELSE c_mktsegment END AS purpose, "
        "'' AS created FROM customer"),
    "edc_flatten": (
        "SELECT c.c_custkey AS record_id, string_agg(upper('f_' || regexp_replace(n.n_name, '[^A-Za-z0-9]', '_', 'g')), "
        f"'|' ORDER BY n.n_nationkey) AS columns, string_agg({_NATION_VALUE}, '|' ORDER BY n.n_nationkey) AS values "
        "FROM customer c, nation n WHERE n.n_regionkey = 2 GROUP BY 1"),
    "anomaly_count_invariant": (
        f"WITH {domain_cte('dm')} SELECT count(*) AS rows, CAST(ceil(0.05 * (count(*) - 1)) AS BIGINT) AS allowed, "
        "true AS fits FROM dm"),
    "validate_all_counts": (
        f"{all_rules_sql()} SELECT rule_id, count(*) AS n FROM all_findings GROUP BY 1 UNION ALL "
        "SELECT 'ANOMALY_001', CAST(ceil(0.05 * (count(*) - 1)) AS BIGINT) FROM dm"),
    "validate_generic_counts": (
        f"SELECT rule_id, count(*) AS n FROM ({sources_sql()['validate_generic_rules']}) f GROUP BY 1 UNION ALL "
        "SELECT 'ANOMALY_001', CAST(ceil(0.05 * (count(*) - 1)) AS BIGINT) FROM customer"),
    "validate_job": job_sql(),
    "validate_job_counts": (
        f"SELECT \"STUDYID\", rule_id, count(*) AS n FROM ({job_sql()}) f GROUP BY 1, 2 UNION ALL "
        f"SELECT 'ST' || ({STUDY_OF['dm']}), 'ANOMALY_001', CAST(ceil(0.05 * (count(*) - 1)) AS BIGINT) FROM ({DOMAIN_VIEWS['dm']}) dm GROUP BY 1"),
    "anomaly_by_study": (
        f"WITH {domain_cte('dm')} SELECT CASE WHEN row_id % 62 > 0 THEN 'ST' || (row_id % 62) END AS \"STUDYID\", count(*) AS rows, "
        "CASE WHEN count(*) < 10 THEN 0 ELSE CAST(ceil(0.05 * (count(*) - 1)) AS BIGINT) END AS flagged FROM dm GROUP BY 1"),
}
