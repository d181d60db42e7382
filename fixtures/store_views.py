"""The tables around the findings, keyed and dated by the given tables, as portable SQL."""

_STUDIES = """
SELECT c_custkey AS id, 'T' || CAST(c_custkey % 4 AS STRING) AS tenant_id, 'ST' || CAST(c_custkey % 1472 AS STRING) AS study_id,
 'Study ' || c_name AS title, CASE c_custkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN NULL ELSE 'III' END AS phase,
 c_mktsegment AS sponsor, CASE WHEN c_nationkey % 2 = 0 THEN 'ONCOLOGY' ELSE 'CARDIOLOGY' END AS therapeutic_area,
 CASE WHEN c_custkey % 9 = 0 THEN 'archived' WHEN c_custkey % 7 = 0 THEN 'locked' ELSE 'active' END AS status,
 DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS created_at FROM customer"""

STORE_VIEWS = {
    "findings": """
SELECT o_orderkey AS id, 'T' || CAST(o_custkey % 4 AS STRING) AS tenant_id, 'ST' || CAST(o_custkey % 7 AS STRING) AS study_id,
 'J' || CAST(o_custkey % 40 AS STRING) AS job_id,
 CASE WHEN o_orderkey % 31 = 0 THEN 'ANOMALY' WHEN o_orderkey % 5 = 0 THEN 'CROSS_DOMAIN' ELSE 'SDTM_RULE' END AS finding_type,
 CASE o_orderkey % 6 WHEN 0 THEN 'SDTM_DM_001' WHEN 1 THEN 'SDTM_AE_002' WHEN 2 THEN 'SDTM_VS_005' WHEN 3 THEN 'SDTM_EX_007' WHEN 4 THEN 'X_DMLINK_AE_001' ELSE 'X_IRT_003' END AS rule_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CRIT' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MED' WHEN '4-NOT SPECIFIED' THEN 'LOW' ELSE CASE WHEN o_orderkey % 10 = 3 THEN 'INFO' ELSE 'LOW' END END AS severity,
 CASE o_orderkey % 6 WHEN 0 THEN 'DM' WHEN 1 THEN 'AE' WHEN 2 THEN 'VS' WHEN 3 THEN 'EX' ELSE 'CROSS' END AS domain,
 CASE o_orderkey % 3 WHEN 0 THEN 'USUBJID' WHEN 1 THEN 'AESTDTC' ELSE 'EXSTDTC/EXENDTC' END AS field,
 CASE WHEN o_orderkey % 4 = 0 THEN 'USUBJID is required and must be non-empty.'
  WHEN o_orderkey % 4 = 1 THEN repeat('EXSTDTC must be on or before EXENDTC. ', CAST(1 + o_orderkey % 9 AS INT)) || ' (found: ''' || CAST(o_totalprice AS STRING) || ''')'
  WHEN o_orderkey % 4 = 2 THEN repeat('No marker in this text ', CAST(1 + o_orderkey % 14 AS INT))
  ELSE 'Short (found: ''a'') and again (found: ''' || repeat('long value ', CAST(1 + o_orderkey % 25 AS INT)) || ''')' END AS message,
 o_orderkey % 1000 AS row_index,
 CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'S' || CAST(o_custkey AS STRING) END AS usubjid,
 CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN repeat('evidence ', 20) ELSE CAST(o_orderkey AS STRING) END AS evidence,
 CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'waived' END AS status,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'U' || CAST(o_custkey % 9 AS STRING) END AS resolved_by,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS resolved_at,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'note' END AS resolution_note,
 o_orderdate AS created_at
 FROM orders""",
    "jobs": """
SELECT 'J' || CAST(o_orderkey AS STRING) AS job_id, 'T' || CAST(o_custkey % 4 AS STRING) AS tenant_id,
 'ST' || CAST(o_custkey % 50 AS STRING) AS study_id,
 split('D' || CAST(o_orderkey % 997 AS STRING) || ',D' || CAST(o_orderkey % 991 + 3 AS STRING), ',') AS dataset_ids,
 CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' ELSE 'completed' END AS status,
 o_orderdate AS created_at,
 CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderdate + INTERVAL '10' SECOND END AS started_at,
 CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL ELSE o_orderdate + INTERVAL '10' SECOND + INTERVAL '7' SECOND * (o_orderkey % 1000) END AS completed_at
 FROM orders""",
    "finding_jobs": """
SELECT 'J' || CAST(k AS STRING) AS job_id, 'T' || CAST(k % 4 AS STRING) AS tenant_id, 'ST' || CAST(k % 10 AS STRING) AS study_id,
 CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, max(o_orderdate) AS completed_at
 FROM (SELECT o_custkey % 40 AS k, o_orderdate FROM orders) o GROUP BY k""",
    "datasets": """
SELECT 'D' || CAST(event_id AS STRING) AS dataset_id, 'T' || CAST(user_id % 4 AS STRING) AS tenant_id,
 'ST' || CAST(user_id % 50 AS STRING) AS study_id,
 CASE event_type WHEN 'view' THEN 'VS' WHEN 'click' THEN 'AE' WHEN 'error' THEN 'EX' WHEN 'signup' THEN 'DM' ELSE 'LB' END AS domain,
 CASE event_id % 6 WHEN 0 THEN 'upload_' || CAST(event_id AS STRING) || '.CSV' WHEN 1 THEN 'data.json' WHEN 2 THEN 'export.xml' WHEN 3 THEN 'dm.csv' WHEN 4 THEN 'noext' ELSE 'ae.Json' END AS filename,
 CASE WHEN event_id % 11 = 0 THEN 'DATASET-JSON' WHEN event_id % 13 = 0 THEN 'sas7bdat' ELSE NULL END AS given_format,
 ts AS created_at FROM events""",
    "studies": _STUDIES,
    "known_studies": """
SELECT DISTINCT 'T' || CAST(c_custkey % 4 AS STRING) AS tenant_id, 'ST' || CAST(c_custkey % 40 AS STRING) AS study_id,
 'Study ' || CAST(c_custkey % 40 AS STRING) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'II' ELSE 'III' END AS phase,
 'Sponsor ' || CAST(c_custkey % 40 AS STRING) AS sponsor, 'ONCOLOGY' AS therapeutic_area FROM customer""",
    "tenants": """
SELECT DISTINCT 'T' || CAST(c_custkey % 3 AS STRING) AS tenant_id, 'Tenant ' || CAST(c_custkey % 3 AS STRING) AS name FROM customer""",
    "audit": """
SELECT event_id AS id, 'T' || CAST(user_id % 4 AS STRING) AS tenant_id, 'U' || CAST(user_id AS STRING) AS user_id,
 CASE event_type WHEN 'view' THEN 'studies.create' WHEN 'click' THEN 'findings.update' WHEN 'error' THEN 'Findings.Delete' WHEN 'signup' THEN 'users.create' ELSE 'validation_jobs.update' END AS action,
 ts AS occurred_at FROM events""",
    "overrides": """
SELECT DISTINCT 'T' || CAST(c_custkey % 4 AS STRING) AS tenant_id, CASE c_custkey % 12 WHEN 1 THEN 'SDTM_VS_005' WHEN 2 THEN 'X_IRT_003' WHEN 3 THEN 'SDTM_AE_002' ELSE 'SDTM_DM_001' END AS rule_id,
 CASE c_custkey % 12 WHEN 2 THEN 'CRIT' WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE 'LOW' END AS severity,
 CASE WHEN c_custkey % 12 IN (1, 2) THEN NULL WHEN c_custkey % 12 = 3 THEN FALSE ELSE TRUE END AS enabled FROM customer""",
    "requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey + CAST(CASE WHEN l_orderkey % 29 = 0 THEN 100000000 ELSE 0 END AS BIGINT) AS id,
 CASE min(l_partkey) % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'waived' ELSE 'resolved' END AS new_status,
 'U' || CAST(min(l_suppkey) AS STRING) AS user_id, min(l_shipdate) AS requested_at, 'note ' || CAST(min(l_suppkey) AS STRING) AS note
 FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "study_edits": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'New title' ELSE NULL END AS title,
 CASE WHEN c_custkey % 15 = 0 THEN 'IV' ELSE NULL END AS phase FROM customer""",
    "studies_after": f"""
SELECT id + CAST(CASE WHEN id % 23 = 0 THEN 1000000000 ELSE 0 END AS BIGINT) AS id, tenant_id, study_id, title, phase, sponsor,
 CASE WHEN id % 19 = 0 THEN 'NEPHROLOGY' ELSE therapeutic_area END AS therapeutic_area, status,
 created_at + CAST(id % 2 AS INT) AS created_at FROM ({_STUDIES}) s""",
}
