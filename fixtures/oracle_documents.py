"""DuckDB SQL for all findings of the derived Dataset-JSON documents."""

from __future__ import annotations

from fixtures.oracle_rules import BLANK, RULES, K, finding, rule_select
from fixtures.oracle_store import DOCS, GOOD_DOCS, RECORDS
from fixtures.views import DOMAIN_VIEWS


def _table(name: str, per: int, columns: list[str], last: str) -> str:
    """A domain's rows within their documents; records cut short lack the last column."""
    kept = ", ".join(columns)
    return (f"{name} AS (SELECT CAST(doc AS STRING) AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY row_id) - 1 "
            f"AS row_id, {kept}, CASE WHEN row_id % 50 <> 3 THEN {last} END AS {last} FROM (SELECT *, row_id // {per} AS "
            f"doc FROM ({DOMAIN_VIEWS[name]}) v) WHERE row_id % 77 <> 5 AND doc IN {GOOD_DOCS})")


def _structural(rule, severity, field, message, source, row_index="-1", evidence="''"):
    return (f"SELECT doc_id, 'DATASET_JSON' AS finding_type, {rule} AS rule_id, '{severity}' AS severity, 'DATASET_JSON' AS "
            f"domain, {field} AS field, {message} AS message, CAST({row_index} AS BIGINT) AS row_index, '' AS usubjid, "
            f"{evidence} AS evidence FROM {source}")


def documents_sql() -> str:
    dm = _table("dm", 100, ["USUBJID", "STUDYID", "SEX", "AGE", "AGEU", "RFSTDTC"], "RFENDTC")
    ae = _table("ae", 1000, ["USUBJID", "AETERM", "AESTDTC", "AEENDTC", "AESER"], "AESEV")
    records = RECORDS
    for name in ("dm", "ae"):
        records = records.replace(f"FROM {name})", f"FROM ({DOMAIN_VIEWS[name]}) v)")
    parts = [
        _structural(
            "rule", "CRIT",
            "CASE rule WHEN 'DJ_001' THEN 'root' WHEN 'DJ_002' THEN 'clinicalData/referenceData' WHEN 'DJ_002b' THEN "
            "'clinicalData' ELSE 'itemGroupData' END",
            "CASE rule WHEN 'DJ_001' THEN 'Dataset-JSON document must be a JSON object.' WHEN 'DJ_002' THEN 'Document must "
            "have a ''clinicalData'' or ''referenceData'' key.' WHEN 'DJ_002b' THEN 'clinicalData must be a JSON object.' "
            "WHEN 'DJ_003' THEN 'Missing ''itemGroupData'' in document.' ELSE 'itemGroupData must be an object.' END",
            "(SELECT CAST(doc AS STRING) AS doc_id, rule FROM tops WHERE rule IS NOT NULL)"),
        _structural(
            "'DJ_110'", "CRIT", "'domain'", "'Could not infer OID for domain ''' || d || '''.'",
            "(SELECT CAST(doc AS STRING) AS doc_id, rule, d FROM tops, (VALUES ('DM'), ('VS'), ('AE'), ('CM')) v(d) "
            "WHERE rule IS NOT NULL OR d IN ('VS', 'CM'))",
            evidence="CASE WHEN rule IS NULL THEN 'IG.AE; IG.ONE' ELSE '' END"),
        _structural(
            "CASE WHEN broken THEN 'DJ_105' ELSE 'DJ_106' END", "HIGH", "oid || '.itemData[' || CAST(n AS STRING) || ']'",
            "CASE WHEN broken THEN 'Each record must be an array.' ELSE 'Record length mismatch.' END",
            f"(SELECT *, CAST(doc AS STRING) AS doc_id FROM ({records}) WHERE broken OR short)", "n",
            "CASE WHEN broken THEN '' ELSE 'got ' || CAST(width - 1 AS STRING) || ', expected ' || CAST(width AS STRING) END"),
    ]
    parts += [rule_select(d, n, True, "doc_id, ") for d in ("dm", "ae") for n in RULES[d] if (d, n) != ("dm", "002")]
    parts.append(finding(
        rule="SDTM_DM_002", sev="HIGH", domain="DM", field="USUBJID", message="USUBJID must be unique in DM.", source="dm",
        where=f"NOT {BLANK('USUBJID')} AND (doc_id, {K('USUBJID')}) IN (SELECT (doc_id, {K('USUBJID')}) FROM dm "
              f"GROUP BY doc_id, {K('USUBJID')} HAVING count(*) > 1)", ev=K("USUBJID"), extra="doc_id, "))
    parts.append(finding(
        ftype="CROSS_DOMAIN", rule="X_DMLINK_AE_001", sev="HIGH", domain="CROSS", field="USUBJID",
        message="AE subject not found in DM (orphan USUBJID).", source="ae",
        where=f"{K('USUBJID')} <> '' AND NOT EXISTS (SELECT 1 FROM dm WHERE dm.doc_id = ae.doc_id AND "
              f"{K('dm.USUBJID')} = {K('ae.USUBJID')})", ev=K("USUBJID"), extra="doc_id, "))
    return f"WITH {DOCS}, {dm}, {ae} " + " UNION ALL ".join(parts)
