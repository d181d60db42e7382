"""The row rules of the eleven study domains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve import vocab
from clinisieve.findings import SDTM_RULE, dataset_finding, union_findings
from clinisieve.functions.text import as_texts
from clinisieve.functions import values as v
from clinisieve.operators.joins import lookup_join
from clinisieve.operators.rules import (
    ROW_INDEX,
    Rule,
    evaluate,
    is_blank,
    listed,
    must_be_date,
    must_be_filled,
    must_be_in,
    must_be_number,
    must_be_ordered,
    result_must_be_number,
    unit_must_fit,
)


@dataclass(frozen=True)
class Domain:
    """``required`` columns gate the whole domain; ``note_missing`` columns are only remarked on."""

    code: str
    required: tuple[str, ...]
    rules: Callable[[], list[Rule]]
    note_missing: tuple[tuple[str, str], ...] = ()


def dm_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_DM_001", "HIGH", "USUBJID"),
        must_be_in("SDTM_DM_003", "MED", "SEX", vocab.SEX, wording="must", show_stripped=True),
        Rule("SDTM_DM_004", "MED", "AGE", "AGE should be between 0 and 120.",
             "AGE__number < 0 OR AGE__number > 120", "AGE", ("AGE",)),
        Rule("SDTM_DM_005", "LOW", "AGEU",
             f"AGEU should be one of: {vocab.AGE_UNITS} when AGE is present.",
             f"AGE__number IS NOT NULL AND AGEU__clean NOT IN {listed(vocab.AGE_UNITS)}",
             "AGEU__clean", ("AGE", "AGEU")),
        must_be_date("SDTM_DM_006", "LOW", "RFSTDTC"),
        must_be_date("SDTM_DM_007", "LOW", "RFENDTC"),
        must_be_ordered("SDTM_DM_008", "HIGH", "RFSTDTC", "RFENDTC"),
    ]


def vs_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_VS_001", "HIGH", "USUBJID"),
        must_be_in("SDTM_VS_002", "MED", "VSTESTCD", vocab.VS_TESTS, show_stripped=True),
        must_be_date("SDTM_VS_003", "LOW", "VSDTC"),
        result_must_be_number("SDTM_VS_004", "HIGH", "VSTESTCD", "VSORRES", vocab.VS_TESTS),
        unit_must_fit("SDTM_VS_005", "MED", "VSTESTCD", "VSORRESU", vocab.VS_UNITS),
    ]


def ae_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_AE_001", "HIGH", "AETERM"),
        must_be_date("SDTM_AE_002", "MED", "AESTDTC"),
        must_be_date("SDTM_AE_003", "LOW", "AEENDTC"),
        must_be_ordered("SDTM_AE_004", "HIGH", "AESTDTC", "AEENDTC"),
        must_be_in("SDTM_AE_005", "MED", "AESER", vocab.AE_SERIOUS, strip=False),
        must_be_in("SDTM_AE_006", "MED", "AESEV", vocab.AE_SEVERITY, strip=False),
    ]


def cm_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_CM_001", "HIGH", "CMTRT"),
        must_be_date("SDTM_CM_002", "MED", "CMSTDTC"),
        must_be_date("SDTM_CM_003", "LOW", "CMENDTC"),
        must_be_ordered("SDTM_CM_004", "HIGH", "CMSTDTC", "CMENDTC"),
    ]


def ex_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_EX_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_EX_002", "HIGH", "EXTRT"),
        must_be_number("SDTM_EX_003", "HIGH", "EXDOSE"),
        Rule("SDTM_EX_004", "MED", "EXDOSE", "EXDOSE should not be negative.",
             "EXDOSE__number < 0", "EXDOSE", ("EXDOSE",)),
        must_be_date("SDTM_EX_005", "LOW", "EXSTDTC"),
        must_be_date("SDTM_EX_006", "LOW", "EXENDTC"),
        must_be_ordered("SDTM_EX_007", "HIGH", "EXSTDTC", "EXENDTC"),
        must_be_in("SDTM_EX_008", "MED", "EXROUTE", vocab.EX_ROUTES),
        must_be_in("SDTM_EX_009", "MED", "EXDOSU", vocab.EX_UNITS),
    ]


def lb_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_LB_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_LB_002", "HIGH", "LBORRES"),
        must_be_in("SDTM_LB_003", "MED", "LBTESTCD", vocab.LB_TESTS, show_stripped=True),
        must_be_date("SDTM_LB_004", "LOW", "LBDTC"),
        must_be_number("SDTM_LB_005", "MED", "LBSTRESN"),
        must_be_in("SDTM_LB_006", "LOW", "LBNRIND", vocab.LB_INDICATORS),
    ]


def ds_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_DS_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_DS_002", "HIGH", "DSDECOD"),
        must_be_in("SDTM_DS_003", "MED", "DSDECOD", vocab.DS_TERMS, show_stripped=True),
        must_be_date("SDTM_DS_004", "LOW", "DSSTDTC"),
        must_be_filled("SDTM_DS_005", "MED", "DSTERM"),
        must_be_in("SDTM_DS_006", "LOW", "DSCAT", vocab.DS_CATEGORIES),
    ]


def eg_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_EG_001", "HIGH", "USUBJID"),
        must_be_in("SDTM_EG_002", "MED", "EGTESTCD", vocab.EG_TESTS, show_stripped=True),
        must_be_date("SDTM_EG_003", "LOW", "EGDTC"),
        result_must_be_number("SDTM_EG_004", "HIGH", "EGTESTCD", "EGORRES", vocab.EG_TESTS),
        unit_must_fit("SDTM_EG_005", "MED", "EGTESTCD", "EGORRESU", vocab.EG_UNITS),
    ]


def _status_rules(prefix: str, status: str, result: str, reason: str) -> list[Rule]:
    """A result must be there unless the assessment was not done, and then a reason must be."""
    not_done = f"{status}__clean = '{vocab.NOT_DONE[0]}'"
    need_result = f"{result} is required unless {status} is '{vocab.NOT_DONE[0]}'."
    need_reason = f"{reason} is required when {status} is '{vocab.NOT_DONE[0]}'."
    return [
        must_be_in(f"{prefix}_006", "MED", status, vocab.NOT_DONE),
        Rule(f"{prefix}_007", "HIGH", result, need_result,
             f"{result} IS NULL AND NOT {not_done}", status, (result, status)),
        Rule(f"{prefix}_007", "HIGH", result, need_result,
             f"{result} IS NULL", result, (result,), absent=(status,)),
        Rule(f"{prefix}_008", "MED", reason, need_reason,
             f"{not_done} AND {is_blank(reason)}", reason, (status, reason)),
        Rule(f"{prefix}_008", "MED", reason, need_reason,
             not_done, status, (status,), absent=(reason,)),
    ]


def qs_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_QS_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_QS_002", "HIGH", "QSCAT"),
        must_be_filled("SDTM_QS_003", "HIGH", "QSTESTCD"),
        must_be_date("SDTM_QS_004", "LOW", "QSDTC"),
        must_be_number("SDTM_QS_005", "MED", "QSSTRESN"),
        *_status_rules("SDTM_QS", "QSSTAT", "QSORRES", "QSREASND"),
    ]


def rs_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_RS_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_RS_002", "HIGH", "RSTESTCD"),
        must_be_in("SDTM_RS_003", "MED", "RSORRES", vocab.RS_RESPONSES, show_stripped=True),
        must_be_date("SDTM_RS_004", "LOW", "RSDTC"),
        must_be_in("SDTM_RS_005", "LOW", "RSEVAL", vocab.RS_EVALUATORS),
        *_status_rules("SDTM_RS", "RSSTAT", "RSORRES", "RSREASND"),
    ]


def pr_rules() -> list[Rule]:
    return [
        must_be_filled("SDTM_PR_001", "HIGH", "USUBJID"),
        must_be_filled("SDTM_PR_002", "HIGH", "PRTRT"),
        must_be_date("SDTM_PR_003", "MED", "PRSTDTC"),
        must_be_date("SDTM_PR_004", "LOW", "PRENDTC"),
        must_be_ordered("SDTM_PR_005", "HIGH", "PRSTDTC", "PRENDTC"),
        must_be_in("SDTM_PR_006", "MED", "PRCAT", vocab.PR_CATEGORIES),
    ]


# Domain codes in reporting order, with the columns each cannot do without.
DOMAINS = {d.code: d for d in [
    Domain("DM", ("USUBJID", "STUDYID"), dm_rules),
    Domain("VS", ("USUBJID", "VSTESTCD", "VSORRES", "VSDTC"), vs_rules,
           (("SDTM_VS_005", "VSORRESU"),)),
    Domain("AE", ("USUBJID", "AETERM", "AESTDTC"), ae_rules),
    Domain("CM", ("USUBJID", "CMTRT", "CMSTDTC"), cm_rules),
    Domain("EX", ("USUBJID", "EXTRT", "EXSTDTC"), ex_rules),
    Domain("LB", ("USUBJID", "LBTESTCD", "LBORRES", "LBDTC"), lb_rules),
    Domain("DS", ("USUBJID", "DSDECOD", "DSSTDTC"), ds_rules),
    Domain("EG", ("USUBJID", "EGTESTCD", "EGORRES", "EGDTC"), eg_rules,
           (("SDTM_EG_005", "EGORRESU"),)),
    Domain("QS", ("USUBJID", "QSCAT", "QSTESTCD", "QSORRES", "QSDTC"), qs_rules),
    Domain("RS", ("USUBJID", "RSTESTCD", "RSORRES", "RSDTC"), rs_rules),
    Domain("PR", ("USUBJID", "PRTRT", "PRSTDTC"), pr_rules),
]}


def missing_columns(df: DataFrame, code: str, scope: tuple[str, ...] = ()) -> DataFrame | None:
    """The finding that a domain lacks columns it cannot do without, or None when it has them."""
    missing = [c for c in DOMAINS[code].required if c not in df.columns]
    if not missing:
        return None
    return dataset_finding(
        df, scope=scope, finding_type=SDTM_RULE, rule_id=f"SDTM_{code}_000", severity="CRIT",
        domain=code, field=",".join(missing),
        message=f"Missing required columns for {code}: {missing}")


#: What is said of each copy of a subject that demographics hold more than once.
DUPLICATE = Rule("SDTM_DM_002", "HIGH", "USUBJID", "USUBJID must be unique in DM.", "true", "_subject", ("USUBJID",))


def duplicate_subjects(dm: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Every copy of a subject that demographics holds more than once.

    Copies are counted per subject (summed before the shuffle) and only the repeated subjects
    go back to the rows, so no task ever holds all copies of one subject.
    """
    filled = dm.filter(~v.blank("USUBJID")).withColumn("_subject", v.clean("USUBJID"))
    on = [*scope, "_subject"]
    repeated = filled.groupBy(*on).count().filter(F.col("count") > 1).select(*on)
    copies = lookup_join(filled, repeated, on, "left_semi")
    return evaluate(copies, [DUPLICATE], domain="DM", scope=scope)


def row_rules(df: DataFrame, code: str, only: set[str] | None = None) -> list[Rule]:
    """The rules of a domain that look at one row and whose columns are there."""
    return [r for r in DOMAINS[code].rules()
            if r.applies_to(df.columns) and (only is None or r.rule_id in only)]


def table_findings(df: DataFrame, code: str, scope: tuple[str, ...] = (),
                   only: set[str] | None = None) -> list[DataFrame]:
    """The findings that need more than one row: repeated subjects, absent optional columns."""
    parts = []
    if code == "DM" and (only is None or "SDTM_DM_002" in only):
        parts.append(duplicate_subjects(df, scope))
    for rule_id, column in DOMAINS[code].note_missing:
        if column not in df.columns and (only is None or rule_id in only):
            parts.append(dataset_finding(
                df, scope=scope, finding_type=SDTM_RULE, rule_id=rule_id, severity="LOW",
                domain=code, field=column,
                message=f"Column {column} not present; unit consistency checks skipped."))
    return parts


def validate_domain(df: DataFrame, code: str, scope: tuple[str, ...] = (),
                    only: set[str] | None = None) -> DataFrame:
    """All row-rule findings of one domain (``only`` keeps the named rules)."""
    df = as_texts(df, ROW_INDEX, *scope)
    lacking = missing_columns(df, code, scope)
    if lacking is not None:
        return lacking
    rules = row_rules(df, code, only)
    parts = [evaluate(df, rules, domain=code, scope=scope)] if rules else []
    return union_findings(parts + table_findings(df, code, scope, only))
