"""DuckDB SQL for the row rules, written independently of the Spark rules."""

from __future__ import annotations

from fixtures.views import DOMAIN_VIEWS

HAS_ROW_ID = {"dm", "ae", "cm", "ex", "pr", "ds", "qs", "rs"}


def K(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def BLANK(c: str) -> str:
    return f"({K(c)} IN ('', 'nan'))"


def D(c: str) -> str:
    return (f"(CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') "
            f"AND try_cast({c} AS DATE) BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' "
            f"THEN try_cast({c} AS DATE) END)")


def N(c: str) -> str:
    return (f"(CASE WHEN regexp_full_match({c}, '(?i)\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)"
            f"(e[+-]?[0-9]+)?|inf(inity)?)\\s*') THEN try_cast({c} AS DOUBLE) END)")


def IN(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def Q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def domain_cte(*names: str) -> str:
    """CTE list for derived domains (nested so each is self-contained)."""
    return ", ".join(f"{n} AS ({DOMAIN_VIEWS[n]})" for n in names)


def finding(*, ftype="SDTM_RULE", rule, sev, domain, field, message, source, where, ev,
            row_index: str | None = "row_id", usubjid="USUBJID", extra="") -> str:
    row = f"CAST({row_index} AS BIGINT) AS row_index, " if row_index else ""
    return (f"SELECT {extra}'{ftype}' AS finding_type, '{rule}' AS rule_id, '{sev}' AS severity, "
            f"'{domain}' AS domain, '{field}' AS field, "
            f"CASE WHEN ev = '' THEN {Q(message)} ELSE {Q(message)} || ' (found: ''' || ev || ''')' END AS message, "
            f"{row}u AS usubjid, ev AS evidence "
            f"FROM (SELECT *, coalesce({ev}, '') AS ev, coalesce({usubjid}, '') AS u FROM {source} WHERE {where}) t")


def _filled(sev, c):
    return (sev, c, f"{c} is required and must be non-empty.", BLANK(c), c)


def _date(sev, c):
    return (sev, c, f"{c} should be ISO date YYYY-MM-DD.", f"{c} IS NOT NULL AND {D(c)} IS NULL", c)


def _num(sev, c):
    return (sev, c, f"{c} should be numeric.", f"{c} IS NOT NULL AND {N(c)} IS NULL", c)


def _in(sev, c, vals, word="should", key=None, ev=None):
    return (sev, c, f"{c} {word} be one of: {vals}.",
            f"{c} IS NOT NULL AND {key or K(c)} NOT IN {IN(vals)}", ev or c)


def _order(sev, a, b):
    return (sev, f"{a}/{b}", f"{a} must be on or before {b}.", f"{D(a)} > {D(b)}", f"{a} || ' > ' || {b}")


def _result(sev, t, r, tests):
    dotted = f"replace({r}, ',', '.')"
    return (sev, r, f"{r} should be numeric for this {t}.",
            f"{K(t)} IN {IN(tests)} AND {r} IS NOT NULL AND {N(dotted)} IS NULL", r)


def _unit(sev, t, u, pairs):
    tests = sorted({a for a, _ in pairs})
    ok = IN([f"{a}|{b}" for a, b in pairs])
    return (sev, u, f"{u} unit is not consistent with {t}.",
            f"{K(t)} IN {IN(tests)} AND {u} IS NOT NULL AND {K(t)} || '|' || {K(u)} NOT IN {ok}",
            f"{K(t)} || ' / ' || {K(u)}")


def _status(st, res, why):
    nd = f"{K(st)} = 'NOT DONE'"
    return {
        "006": _in("MED", st, ["NOT DONE"]),
        "007": ("HIGH", res, f"{res} is required unless {st} is 'NOT DONE'.",
                f"{res} IS NULL AND NOT ({nd})", st),
        "008": ("MED", why, f"{why} is required when {st} is 'NOT DONE'.", f"{nd} AND {BLANK(why)}", why),
    }


_VS = ["SYSBP", "DIABP", "PULSE", "TEMP", "WEIGHT", "HEIGHT", "RESP"]
_VSU = [("SYSBP", "mmHg"), ("DIABP", "mmHg"), ("PULSE", "beats/min"), ("PULSE", "bpm"),
        ("RESP", "breaths/min"), ("RESP", "bpm"), ("TEMP", "C"), ("TEMP", "F"), ("WEIGHT", "kg"),
        ("WEIGHT", "g"), ("WEIGHT", "lb"), ("HEIGHT", "cm"), ("HEIGHT", "m"), ("HEIGHT", "in")]
_EG = ["QT", "QTCF", "QTCB", "HR", "PR", "QRS", "RR"]
_EGU = [(t, u) for t in ("QT", "QTCF", "QTCB", "PR", "QRS", "RR") for u in ("msec", "ms")] + [
    ("HR", "beats/min"), ("HR", "bpm")]

RULES = {
    "dm": {
        "001": _filled("HIGH", "USUBJID"),
        "002": ("HIGH", "USUBJID", "USUBJID must be unique in DM.",
                f"NOT {BLANK('USUBJID')} AND {K('USUBJID')} IN (SELECT {K('USUBJID')} FROM dm "
                f"WHERE NOT {BLANK('USUBJID')} GROUP BY 1 HAVING count(*) > 1)", K("USUBJID")),
        "003": _in("MED", "SEX", ["M", "F", "U"], "must", ev=K("SEX")),
        "004": ("MED", "AGE", "AGE should be between 0 and 120.", f"{N('AGE')} < 0 OR {N('AGE')} > 120", "AGE"),
        "005": ("LOW", "AGEU", "AGEU should be one of: ['YEARS', 'MONTHS', 'DAYS'] when AGE is present.",
                f"{N('AGE')} IS NOT NULL AND {K('AGEU')} NOT IN ('YEARS', 'MONTHS', 'DAYS')", K("AGEU")),
        "006": _date("LOW", "RFSTDTC"), "007": _date("LOW", "RFENDTC"),
        "008": _order("HIGH", "RFSTDTC", "RFENDTC"),
    },
    "vs": {
        "001": _filled("HIGH", "USUBJID"), "002": _in("MED", "VSTESTCD", _VS, ev=K("VSTESTCD")),
        "003": _date("LOW", "VSDTC"), "004": _result("HIGH", "VSTESTCD", "VSORRES", _VS),
        "005": _unit("MED", "VSTESTCD", "VSORRESU", _VSU),
    },
    "ae": {
        "001": _filled("HIGH", "AETERM"), "002": _date("MED", "AESTDTC"), "003": _date("LOW", "AEENDTC"),
        "004": _order("HIGH", "AESTDTC", "AEENDTC"),
        "005": _in("MED", "AESER", ["Y", "N"], key="AESER"),
        "006": _in("MED", "AESEV", ["MILD", "MODERATE", "SEVERE"], key="AESEV"),
    },
    "cm": {
        "001": _filled("HIGH", "CMTRT"), "002": _date("MED", "CMSTDTC"), "003": _date("LOW", "CMENDTC"),
        "004": _order("HIGH", "CMSTDTC", "CMENDTC"),
    },
    "ex": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "EXTRT"), "003": _num("HIGH", "EXDOSE"),
        "004": ("MED", "EXDOSE", "EXDOSE should not be negative.", f"{N('EXDOSE')} < 0", "EXDOSE"),
        "005": _date("LOW", "EXSTDTC"), "006": _date("LOW", "EXENDTC"), "007": _order("HIGH", "EXSTDTC", "EXENDTC"),
        "008": _in("MED", "EXROUTE", ["ORAL", "INTRAVENOUS", "SUBCUTANEOUS", "INTRAMUSCULAR", "TOPICAL",
                                      "INHALATION", "TRANSDERMAL"]),
        "009": _in("MED", "EXDOSU", ["mg", "g", "mcg", "mL", "IU"]),
    },
    "lb": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "LBORRES"),
        "003": _in("MED", "LBTESTCD", ["ALT", "AST", "BILI", "CREAT", "BUN", "HGB", "HCT", "WBC", "PLAT", "NA",
                                       "K", "CL", "GLUC", "ALB"], ev=K("LBTESTCD")),
        "004": _date("LOW", "LBDTC"), "005": _num("MED", "LBSTRESN"),
        "006": _in("LOW", "LBNRIND", ["NORMAL", "HIGH", "LOW", "ABNORMAL"]),
    },
    "ds": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "DSDECOD"),
        "003": _in("MED", "DSDECOD", ["COMPLETED", "DEATH", "ADVERSE EVENT", "LOST TO FOLLOW-UP",
                                      "PHYSICIAN DECISION", "PROTOCOL DEVIATION", "WITHDRAWAL BY SUBJECT",
                                      "STUDY TERMINATED BY SPONSOR", "LACK OF EFFICACY"], ev=K("DSDECOD")),
        "004": _date("LOW", "DSSTDTC"), "005": _filled("MED", "DSTERM"),
        "006": _in("LOW", "DSCAT", ["DISPOSITION EVENT", "PROTOCOL MILESTONE"]),
    },
    "eg": {
        "001": _filled("HIGH", "USUBJID"), "002": _in("MED", "EGTESTCD", _EG, ev=K("EGTESTCD")),
        "003": _date("LOW", "EGDTC"), "004": _result("HIGH", "EGTESTCD", "EGORRES", _EG),
        "005": _unit("MED", "EGTESTCD", "EGORRESU", _EGU),
    },
    "qs": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "QSCAT"), "003": _filled("HIGH", "QSTESTCD"),
        "004": _date("LOW", "QSDTC"), "005": _num("MED", "QSSTRESN"), **_status("QSSTAT", "QSORRES", "QSREASND"),
    },
    "rs": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "RSTESTCD"),
        "003": _in("MED", "RSORRES", ["CR", "PR", "SD", "PD", "NE"], ev=K("RSORRES")),
        "004": _date("LOW", "RSDTC"),
        "005": _in("LOW", "RSEVAL", ["INVESTIGATOR", "INDEPENDENT ASSESSOR", "INDEPENDENT REVIEW COMMITTEE"]),
        **_status("RSSTAT", "RSORRES", "RSREASND"),
    },
    "pr": {
        "001": _filled("HIGH", "USUBJID"), "002": _filled("HIGH", "PRTRT"), "003": _date("MED", "PRSTDTC"),
        "004": _date("LOW", "PRENDTC"), "005": _order("HIGH", "PRSTDTC", "PRENDTC"),
        "006": _in("MED", "PRCAT", ["SURGICAL", "DIAGNOSTIC", "THERAPEUTIC", "OTHER"]),
    },
}


def rule_select(domain: str, number: str, row_index: bool | None = None, extra: str = "") -> str:
    sev, field, message, where, ev = RULES[domain][number]
    keep = domain in HAS_ROW_ID if row_index is None else row_index
    return finding(rule=f"SDTM_{domain.upper()}_{number}", sev=sev, domain=domain.upper(), field=field,
                   message=message, source=domain, where=where, ev=ev,
                   row_index="row_id" if keep else None, extra=extra)


def rule_sql(domain: str, number: str) -> str:
    return f"WITH {domain_cte(domain)} {rule_select(domain, number)}"


#: Columns of the typed variants of some domains, and the kinds they are cast to; what does not fit is null.
TYPED = {"dm": {"AGE": "int", "RFSTDTC": "date", "RFENDTC": "timestamp"}, "ex": {"EXDOSE": "double", "EXSTDTC": "date"},
         "vs": {"VSDTC": "timestamp", "VSORRES": "bigint"}}
_SPELLED = {"int": "CAST(try_cast({c} AS INTEGER) AS VARCHAR)", "bigint": "CAST(try_cast({c} AS BIGINT) AS VARCHAR)",
            "double": "CAST(try_cast({c} AS DOUBLE) AS VARCHAR)"}


def typed_sql() -> str:
    """The row rules over the same tables with the typed columns spelled as texts."""
    ctes, parts = [], []
    for domain, kinds in TYPED.items():
        # A day is one only if it is written in full, or with unpadded parts.
        day = "CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{1,2}}(-[0-9]{{1,2}})?') THEN CAST(try_cast(CASE WHEN length({c}) - length(replace({c}, '-', '')) = 1 THEN {c} || '-01' ELSE {c} END AS DATE) AS VARCHAR) END"
        spelled = ", ".join(f"{_SPELLED.get(kind, day).format(c=c)} AS {c}" for c, kind in kinds.items())
        ctes.append(f"{domain} AS (SELECT * REPLACE ({spelled}) FROM ({DOMAIN_VIEWS[domain]}) given)")
        parts += [rule_select(domain, number, row_index=False) for number in RULES[domain]]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"({p})" for p in parts)


def _dataset_sql(source: str, ftype: str, rule: str, domain: str, field: str, message: str) -> str:
    return (f"(SELECT '{ftype}' AS finding_type, '{rule}' AS rule_id, 'CRIT' AS severity, '{domain}' AS domain, '{field}' AS field, "
            f"{Q(message)} AS message, CAST(-1 AS BIGINT) AS row_index, '' AS usubjid, '' AS evidence FROM (SELECT 1 FROM ({DOMAIN_VIEWS[source]}) given LIMIT 1) one)")


def lacking_sql(missing: dict[str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(_dataset_sql(
        d, "SDTM_RULE", f"SDTM_{d.upper()}_000", d.upper(), ",".join(columns), f"Missing required columns for {d.upper()}: {list(columns)}")
        for d, columns in missing.items())


def links_lacking_sql(linked: list[str]) -> str:
    return " UNION ALL ".join(_dataset_sql(d, "CROSS_DOMAIN", f"X_DMLINK_{d.upper()}_000", "CROSS", "USUBJID",
                                           f"Missing USUBJID for DM/{d.upper()} link check.") for d in linked)


def pairs_lacking_sql() -> str:
    return " UNION ALL ".join(_dataset_sql(source, "CROSS_DOMAIN", rule, "CROSS", field, message) for source, rule, field, message in (
        ("ae", "X_VSAE_000", "USUBJID/--DTC", "Missing required columns for VS/AE cross checks."),
        ("cm", "X_VSCM_000", "USUBJID/--DTC", "Missing required columns for VS/CM cross checks."),
        ("ex", "X_IRT_000", "USUBJID", "Missing required columns for IRT (EX/DM/DS) consistency checks.")))
