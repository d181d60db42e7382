"""DuckDB SQL for cross-domain rules, features and range rules."""

from __future__ import annotations

from fixtures.oracle_rules import HAS_ROW_ID, RULES, D, K, N, domain_cte, finding, rule_select

LINKED = ("vs", "ae", "cm", "ex", "lb", "ds", "eg", "qs", "rs", "pr")


def _cross(rule, sev, field, message, source, where, ev, row_index, extra=""):
    return finding(ftype="CROSS_DOMAIN", rule=rule, sev=sev, domain="CROSS", field=field, message=message,
                   source=source, where=where, ev=ev, row_index="row_id" if row_index else None, extra=extra)


def _ri(domain: str, row_index: bool | None) -> bool:
    return domain in HAS_ROW_ID if row_index is None else row_index


def link_select(d: str, row_index: bool | None = None) -> str:
    return _cross(f"X_DMLINK_{d.upper()}_001", "HIGH", "USUBJID",
                  f"{d.upper()} subject not found in DM (orphan USUBJID).", d,
                  f"{K('USUBJID')} <> '' AND {K('USUBJID')} NOT IN (SELECT {K('USUBJID')} FROM dm)",
                  K("USUBJID"), _ri(d, row_index))


VS_RANGE = (f"SELECT {K('USUBJID')} AS subject, min({D('VSDTC')}) AS vs_min, max({D('VSDTC')}) AS vs_max "
            f"FROM vs WHERE {D('VSDTC')} IS NOT NULL GROUP BY 1")
CM_WINDOW = (f"SELECT {K('USUBJID')} AS subject, min({D('CMSTDTC')}) AS cm_min, max({D('CMENDTC')}) AS cm_max "
             f"FROM cm WHERE {D('CMSTDTC')} IS NOT NULL GROUP BY 1")
DS_EXIT = (f"SELECT {K('USUBJID')} AS subject, min({D('DSSTDTC')}) AS ds_exit FROM ds "
           f"WHERE {D('DSSTDTC')} IS NOT NULL AND ({K('DSCAT')} = 'DISPOSITION EVENT' OR NOT EXISTS "
           f"(SELECT 1 FROM ds WHERE {K('DSCAT')} = 'DISPOSITION EVENT')) GROUP BY 1")
DOSES = (f"SELECT *, {K('USUBJID')} AS subject, coalesce({D('EXENDTC')}, {D('EXSTDTC')}) AS last_dose "
         f"FROM ex WHERE {D('EXSTDTC')} IS NOT NULL")
DM_DATES = (f"SELECT {K('USUBJID')} AS subject, {D('RFSTDTC')} AS st, {D('RFENDTC')} AS en FROM dm "
            f"WHERE {D('RFSTDTC')} IS NOT NULL")


def cross_selects(row_index: bool | None = None) -> dict[str, str]:
    out = {}
    for d, code in (("ae", "X_VSAE_001"), ("cm", "X_VSCM_001")):
        out[code.lower()] = _cross(
            code, "HIGH", "USUBJID", f"{d.upper()} subject not found in VS (orphan USUBJID).", d,
            f"{K('USUBJID')} <> '' AND {K('USUBJID')} NOT IN (SELECT {K('USUBJID')} FROM vs)",
            K("USUBJID"), _ri(d, row_index))
    out["x_vsae_002"] = _cross(
        "X_VSAE_002", "MED", "AESTDTC", "AE start date is outside the subject's VS date range.",
        f"(SELECT * FROM ae JOIN ({VS_RANGE}) w ON {K('ae.USUBJID')} = w.subject) j",
        f"{D('AESTDTC')} < vs_min OR {D('AESTDTC')} > vs_max",
        "AESTDTC || ' vs [' || CAST(vs_min AS STRING) || ', ' || CAST(vs_max AS STRING) || ']'",
        _ri("ae", row_index))
    out["x_vscm_002"] = _cross(
        "X_VSCM_002", "LOW", "VSDTC", "VS date is outside the subject's CM medication window.",
        f"(SELECT * FROM vs JOIN ({CM_WINDOW}) w ON {K('vs.USUBJID')} = w.subject) j",
        f"cm_max IS NOT NULL AND ({D('VSDTC')} < cm_min OR {D('VSDTC')} > cm_max)",
        "VSDTC || ' vs [' || CAST(cm_min AS STRING) || ', ' || CAST(cm_max AS STRING) || ']'",
        _ri("vs", row_index))
    out["x_irt_001"] = _cross(
        "X_IRT_001", "HIGH", "EXSTDTC",
        "EX dosing started before the subject's DM reference start date (RFSTDTC).",
        f"(SELECT * FROM ({DOSES}) e JOIN ({DM_DATES}) p USING (subject)) j", f"{D('EXSTDTC')} < st",
        "'EXSTDTC=' || EXSTDTC || ' < RFSTDTC=' || CAST(st AS STRING)", _ri("ex", row_index))
    out["x_irt_002"] = _cross(
        "X_IRT_002", "MED", "EXENDTC",
        "EX dosing extended beyond the subject's DM reference end date (RFENDTC).",
        f"(SELECT * FROM ({DOSES}) e JOIN ({DM_DATES}) p USING (subject)) j", "last_dose > en",
        "'last dose=' || CAST(last_dose AS STRING) || ' > RFENDTC=' || CAST(en AS STRING)", _ri("ex", row_index))
    out["x_irt_003"] = _cross(
        "X_IRT_003", "HIGH", "EXENDTC", "EX dosing occurred after the subject's DS disposition date.",
        f"(SELECT * FROM ({DOSES}) e JOIN ({DS_EXIT}) p USING (subject)) j", "last_dose > ds_exit",
        "'last dose=' || CAST(last_dose AS STRING) || ' > DSSTDTC=' || CAST(ds_exit AS STRING)",
        _ri("ex", row_index))
    return out


CROSS_NEEDS = {"x_vsae_001": ("vs", "ae"), "x_vsae_002": ("vs", "ae"), "x_vscm_001": ("vs", "cm"),
               "x_vscm_002": ("vs", "cm"), "x_irt_001": ("dm", "ex"), "x_irt_002": ("dm", "ex"),
               "x_irt_003": ("ex", "ds")}

FEATURE_SQL = {
    "SYSBP": ("vs", f"avg(CASE WHEN VSTESTCD = 'SYSBP' THEN {N('VSORRES')} END)"),
    "VSDTC": ("vs", "min(VSDTC)"),
    "DOSE": ("ex", f"avg({N('EXDOSE')})"),
    "ALT": ("lb", f"avg(CASE WHEN LBTESTCD = 'ALT' THEN {N('LBSTRESN')} END)"),
    "QTCF": ("eg", f"avg(CASE WHEN EGTESTCD IN ('QTCF', 'QT') THEN {N('EGORRES')} END)"),
    "QS_SCORE": ("qs", f"avg({N('QSSTRESN')})"),
    "PR_COUNT": ("pr", "count(*)"),
}
FRAME_DOMAINS = ("dm", "vs", "ex", "lb", "eg", "qs", "pr")


def feature_sql(name: str) -> str:
    """One feature per subject, for subjects that have any value."""
    d, agg = FEATURE_SQL[name]
    return (f"WITH {domain_cte(d)} SELECT USUBJID, {agg} AS {name} FROM {d} "
            f"WHERE USUBJID IS NOT NULL GROUP BY USUBJID HAVING {agg} IS NOT NULL")


def frame_select() -> str:
    joins = " ".join(
        f"LEFT JOIN (SELECT USUBJID AS k_{n}, {agg} AS {n} FROM {d} WHERE USUBJID IS NOT NULL GROUP BY 1) "
        f"f_{n} ON dm.USUBJID = f_{n}.k_{n}" for n, (d, agg) in FEATURE_SQL.items())
    cols = ", ".join("CAST(coalesce(PR_COUNT, 0) AS DOUBLE) AS PR_COUNT" if n == "PR_COUNT" else n
                     for n in FEATURE_SQL)
    return (f"SELECT CAST(dm.row_id AS BIGINT) AS row_index, dm.USUBJID AS USUBJID, {N('dm.AGE')} AS AGE, {cols} "
            f"FROM dm {joins}")


WHOLE_AGE = ("(SELECT bool_and(coalesce(regexp_full_match(AGE, '\\s*[+-]?[0-9]+\\s*'), false)) FROM dm)")


def num_text(c: str, whole: str = "false") -> str:
    return f"CASE WHEN {whole} THEN CAST(CAST({c} AS BIGINT) AS STRING) ELSE CAST({c} AS STRING) END"


def generic_selects() -> dict[str, str]:
    out = {}
    for key, col, test, ev in (
        ("generic_age", "AGE", "coalesce(AGE BETWEEN 18 AND 120, false)", num_text("AGE", WHOLE_AGE)),
        ("generic_sysbp", "SYSBP", "coalesce(SYSBP BETWEEN 90 AND 180, false)", num_text("SYSBP")),
        ("generic_dose", "DOSE", "coalesce(DOSE >= 0.001, false)", num_text("DOSE")),
        ("generic_date", "date", "VSDTC IS NOT NULL", "''"),
    ):
        out[key] = finding(rule=f"GENERIC_{col.upper()}_001", sev="MED", domain="GENERAL", field=col,
                           message=f"{col} failed validation rule.", source="frame", where=f"NOT ({test})",
                           ev=ev, row_index="row_index")
    return out


def generic_sql(key: str) -> str:
    return f"WITH {domain_cte(*FRAME_DOMAINS)}, frame AS ({frame_select()}) {generic_selects()[key]}"


def all_rules_sql(row_index: bool = False) -> str:
    """Every row, cross and range finding; without row positions, which some domains do not have."""
    parts = [rule_select(d, n, row_index) for d, rules in RULES.items() for n in rules]
    parts += [link_select(d, row_index) for d in LINKED]
    parts += list(cross_selects(row_index).values())
    keep = "finding_type, rule_id, severity, domain, field, message, usubjid, evidence"
    parts += [f"SELECT {keep} FROM ({s})" for s in generic_selects().values()]
    return (f"WITH {domain_cte(*RULES)}, frame AS ({frame_select()}), all_findings AS ("
            + " UNION ALL ".join(parts) + ")")
