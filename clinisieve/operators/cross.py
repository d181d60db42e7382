"""Consistency between domains: orphan subjects, and events outside a subject's windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.findings import CROSS_DOMAIN, dataset_finding, union_findings
from clinisieve.functions.text import as_texts
from clinisieve.functions import values as v
from clinisieve.operators.facts import occurs
from clinisieve.operators.joins import broadcast_limit, has_rows, lookup_join, planned_bytes
from clinisieve.operators.rules import ROW_INDEX, Rule, evaluate
from clinisieve.operators.subjects import (
    SUBJECT,
    cm_window,
    distinct_subjects,
    ds_exit_date,
    subject,
    vs_date_range,
)
from clinisieve.sources.scratch import written

# The domains that are linked to demographics.
LINKED = ("VS", "AE", "CM", "EX", "LB", "DS", "EG", "QS", "RS", "PR")
BLOCK = 4096


# --- the rules, over event rows joined with what is known about their subject -----------------

def _rule(*args) -> Rule:
    return Rule(*args, domain="CROSS", finding_type=CROSS_DOMAIN)


def orphan_rule(rule_id: str, code: str, table: str, known: str) -> Rule:
    return _rule(rule_id, "HIGH", "USUBJID", f"{code} subject not found in {table} (orphan USUBJID).",
                 f"{SUBJECT} <> '' AND {known} IS NULL", SUBJECT, ("USUBJID",))


def link_rule(code: str) -> Rule:
    return orphan_rule(f"X_DMLINK_{code}_001", code, "DM", "in_dm")


AE_IN_VS = orphan_rule("X_VSAE_001", "AE", "VS", "in_vs")
CM_IN_VS = orphan_rule("X_VSCM_001", "CM", "VS", "in_vs")
AE_IN_VS_RANGE = _rule(
    "X_VSAE_002", "MED", "AESTDTC", "AE start date is outside the subject's VS date range.",
    "AESTDTC__date < vs_min OR AESTDTC__date > vs_max",
    "AESTDTC || ' vs [' || vs_min || ', ' || vs_max || ']'", ("AESTDTC",))
VS_IN_CM_WINDOW = _rule(
    "X_VSCM_002", "LOW", "VSDTC", "VS date is outside the subject's CM medication window.",
    "cm_max IS NOT NULL AND (VSDTC__date < cm_min OR VSDTC__date > cm_max)",
    "VSDTC || ' vs [' || cm_min || ', ' || cm_max || ']'", ("VSDTC",))
DOSE_AFTER_START = _rule(
    "X_IRT_001", "HIGH", "EXSTDTC",
    "EX dosing started before the subject's DM reference start date (RFSTDTC).",
    "EXSTDTC__date < rf_start", "'EXSTDTC=' || EXSTDTC || ' < RFSTDTC=' || rf_start", ("EXSTDTC",))
DOSE_BEFORE_END = _rule(
    "X_IRT_002", "MED", "EXENDTC",
    "EX dosing extended beyond the subject's DM reference end date (RFENDTC).",
    "last_dose > rf_end", "'last dose=' || last_dose || ' > RFENDTC=' || rf_end", ())
DOSE_BEFORE_EXIT = _rule(
    "X_IRT_003", "HIGH", "EXENDTC", "EX dosing occurred after the subject's DS disposition date.",
    "last_dose > ds_exit", "'last dose=' || last_dose || ' > DSSTDTC=' || ds_exit", ())


# --- columns a pair of domains cannot do without -----------------------------------------------

def _pair_finding(df: DataFrame, scope: tuple[str, ...], rule_id: str, field: str, message: str) -> DataFrame:
    return dataset_finding(df, scope=scope, finding_type=CROSS_DOMAIN, rule_id=rule_id, severity="CRIT",
                           domain="CROSS", field=field, message=message)


def _lacks(df: DataFrame, *columns: str) -> bool:
    return any(c not in df.columns for c in columns)


def link_gap(dm: DataFrame, other: DataFrame, code: str, scope: tuple[str, ...] = ()) -> DataFrame | None:
    if not (_lacks(dm, "USUBJID") or _lacks(other, "USUBJID")):
        return None
    return _pair_finding(other, scope, f"X_DMLINK_{code}_000", "USUBJID",
                         f"Missing USUBJID for DM/{code} link check.")


def vs_ae_gap(vs: DataFrame, ae: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame | None:
    if not (_lacks(vs, "USUBJID", "VSDTC") or _lacks(ae, "USUBJID", "AESTDTC")):
        return None
    return _pair_finding(ae, scope, "X_VSAE_000", "USUBJID/--DTC",
                         "Missing required columns for VS/AE cross checks.")


def vs_cm_gap(vs: DataFrame, cm: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame | None:
    if not (_lacks(vs, "USUBJID", "VSDTC") or _lacks(cm, "USUBJID", "CMSTDTC")):
        return None
    return _pair_finding(cm, scope, "X_VSCM_000", "USUBJID/--DTC",
                         "Missing required columns for VS/CM cross checks.")


def irt_gap(dm: DataFrame, ex: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame | None:
    if not (_lacks(dm, "USUBJID", "RFSTDTC") or _lacks(ex, "USUBJID", "EXSTDTC")):
        return None
    return _pair_finding(ex, scope, "X_IRT_000", "USUBJID",
                         "Missing required columns for IRT (EX/DM/DS) consistency checks.")


# --- event rows, as narrow as the checks allow ---------------------------------------------------

def _texts(scope: tuple[str, ...], *tables: DataFrame) -> list[DataFrame]:
    return [as_texts(df, ROW_INDEX, *scope) for df in tables]


def _events(df: DataFrame, scope: tuple[str, ...], *columns: str) -> DataFrame:
    keep = [c for c in (ROW_INDEX, "USUBJID", *columns) if c in df.columns]
    return df.select(*scope, *keep, subject())


def _gate(events: DataFrame, other: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Nothing is an orphan of a table that is empty (for the study concerned)."""
    if scope:
        return lookup_join(events, other.select(*scope).distinct(), list(scope), "left_semi")
    return events.filter(has_rows(other))


def _orphans(df: DataFrame, parent: DataFrame, rule: Rule, scope: tuple[str, ...]) -> DataFrame:
    events = _events(df, scope).filter(F.col(SUBJECT) != "")
    orphans = lookup_join(events, distinct_subjects(parent, scope), [*scope, SUBJECT], "left_anti")
    always = replace(rule, predicate="true")
    return evaluate(_gate(orphans, parent, scope), [always], domain="CROSS", scope=scope)


def _outside(events: DataFrame, windows: DataFrame, rules: list[Rule], scope: tuple[str, ...]) -> DataFrame:
    joined = lookup_join(events, windows, [*scope, SUBJECT], "inner")
    return evaluate(joined, rules, domain="CROSS", scope=scope)


def dm_link(dm: DataFrame, other: DataFrame, code: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``other`` whose subject demographics does not know."""
    dm, other = _texts(scope, dm, other)
    gap = link_gap(dm, other, code, scope)
    return gap if gap is not None else _orphans(other, dm, link_rule(code), scope)


def vs_ae(vs: DataFrame, ae: DataFrame, scope: tuple[str, ...] = (),
          only: set[str] | None = None) -> DataFrame:
    """Adverse events without vital signs, or outside the subject's vital-signs dates."""
    vs, ae = _texts(scope, vs, ae)
    gap = vs_ae_gap(vs, ae, scope)
    if gap is not None:
        return gap
    return _chosen(only, {
        "X_VSAE_001": lambda: _orphans(ae, vs, AE_IN_VS, scope),
        "X_VSAE_002": lambda: _outside(_events(ae, scope, "AESTDTC"), vs_date_range(vs, scope),
                                       [AE_IN_VS_RANGE], scope),
    })


def vs_cm(vs: DataFrame, cm: DataFrame, scope: tuple[str, ...] = (),
          only: set[str] | None = None) -> DataFrame:
    """Medications without vital signs, and vital signs outside the medication window."""
    vs, cm = _texts(scope, vs, cm)
    gap = vs_cm_gap(vs, cm, scope)
    if gap is not None:
        return gap
    checks = {"X_VSCM_001": lambda: _orphans(cm, vs, CM_IN_VS, scope)}
    if "CMENDTC" in cm.columns:
        checks["X_VSCM_002"] = lambda: _outside(
            _events(vs, scope, "VSDTC"), cm_window(cm, scope), [VS_IN_CM_WINDOW], scope)
    return _chosen(only, checks)


def _last_dose(ex: DataFrame) -> Column:
    """The last day dosed: the end, or the start where no end is known; null without a start."""
    start = v.iso_date("EXSTDTC")
    end = v.iso_date("EXENDTC") if "EXENDTC" in ex.columns else F.lit(None)
    return F.when(start.isNotNull(), F.coalesce(end, start))


def doses(ex: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Dosing rows that have a start date."""
    keep = [c for c in (ROW_INDEX, "USUBJID", "EXSTDTC") if c in ex.columns]
    return ex.select(*scope, *keep, subject(), _last_dose(ex).alias("last_dose")).filter(
        "last_dose IS NOT NULL")


def reference_periods(dm: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The distinct reference periods of each subject, and how many rows state each."""
    end = v.iso_date("RFENDTC") if "RFENDTC" in dm.columns else F.lit(None).cast("date")
    days = dm.select(*scope, subject(), v.iso_date("RFSTDTC").alias("rf_start"), end.alias("rf_end"))
    return days.filter("rf_start IS NOT NULL").groupBy(*scope, SUBJECT, "rf_start", "rf_end").agg(
        F.count(F.lit(1)).alias("copies"))


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its count says, in blocks so that no row grows a long list."""
    n = F.col(times)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / BLOCK))
    left = F.least(n - F.col("_block") * BLOCK, F.lit(BLOCK))
    return (df.withColumn("_block", F.explode(blocks))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
            .drop("_block", "_copy", times))


def dose_periods(dm: DataFrame, ex: DataFrame, scope: tuple[str, ...] = (),
                 only: set[str] | None = None) -> DataFrame:
    """Doses before the reference start or after the reference end, once per demographics row.

    Repeated demographics rows are joined once and only the findings are repeated.
    """
    rules = [r for r in (DOSE_AFTER_START, DOSE_BEFORE_END) if only is None or r.rule_id in only]
    joined = lookup_join(doses(ex, scope), reference_periods(dm, scope), [*scope, SUBJECT], "inner")
    found = evaluate(joined, rules, domain="CROSS", scope=(*scope, "copies"))
    return _repeat(found, "copies")


def irt(dm: DataFrame, ex: DataFrame, ds: DataFrame | None, scope: tuple[str, ...] = (),
        only: set[str] | None = None) -> DataFrame:
    """Dosing outside the subject's time in the study."""
    dm, ex = _texts(scope, dm, ex)
    gap = irt_gap(dm, ex, scope)
    if gap is not None:
        return gap
    checks: dict[str, Callable[[], DataFrame]] = {}
    periods = {"X_IRT_001", "X_IRT_002"} & (only or {"X_IRT_001", "X_IRT_002"})
    if periods:
        checks[min(periods)] = lambda: dose_periods(dm, ex, scope, periods)
    if ds is not None and not _lacks(ds, "USUBJID", "DSSTDTC"):
        ds, = _texts(scope, ds)
        checks["X_IRT_003"] = lambda: _outside(doses(ex, scope), ds_exit_date(ds, scope),
                                               [DOSE_BEFORE_EXIT], scope)
    return _chosen(only, checks)


def _chosen(only: set[str] | None, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    return union_findings([build() for rule_id, build in checks.items() if only is None or rule_id in only])


def _within_study(rule: Rule) -> Rule:
    """An orphan only counts where the study has the parent domain at all."""
    parent = {"in_dm IS NULL": "has_dm", "in_vs IS NULL": "has_vs"}
    needed = [flag for test, flag in parent.items() if test in rule.predicate]
    return replace(rule, predicate=" AND ".join([f"({rule.predicate})", *needed]))


# --- all checks of a study -------------------------------------------------------------------------

def study_checks(frames: dict[str, DataFrame], scope: tuple[str, ...] = ()
                 ) -> tuple[dict[str, list[Rule]], list[DataFrame]]:
    """What to check between the given, non-empty domains.

    Returns the rules to test on each domain's rows once they are joined with the subject table
    (see :func:`with_subjects`), and the findings that do not come from such a join: missing
    columns, and doses against every reference period of a subject.
    """
    found: list[DataFrame] = []
    rules: dict[str, list[Rule]] = {code: [] for code in LINKED if code in frames}
    dm, vs, ae, cm, ex, ds = (frames.get(c) for c in ("DM", "VS", "AE", "CM", "EX", "DS"))

    def check(gap: DataFrame | None, add: dict[str, list[Rule]]) -> bool:
        if gap is not None:
            found.append(gap)
            return False
        for code, more in add.items():
            rules[code] += more
        return True

    if dm is not None:
        for code in rules:
            check(link_gap(dm, frames[code], code, scope), {code: [link_rule(code)]})
    if dm is not None and ex is not None:
        has_exit = ds is not None and not _lacks(ds, "USUBJID", "DSSTDTC")
        if check(irt_gap(dm, ex, scope), {"EX": [DOSE_BEFORE_EXIT] if has_exit else []}):
            found.append(dose_periods(dm, ex, scope))
    if vs is not None and ae is not None:
        check(vs_ae_gap(vs, ae, scope), {"AE": [AE_IN_VS, AE_IN_VS_RANGE]})
    if vs is not None and cm is not None:
        window = [VS_IN_CM_WINDOW] if "CMENDTC" in cm.columns else []
        check(vs_cm_gap(vs, cm, scope), {"CM": [CM_IN_VS], "VS": window})
    if scope:
        rules = {code: [_within_study(r) for r in tests] for code, tests in rules.items()}
    return {code: tests for code, tests in rules.items() if tests}, found


def study_presence(subjects: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Whether a study has demographics and vital signs at all, one row per study."""
    return subjects.groupBy(*scope).agg(F.max("in_dm").alias("has_dm"), F.max("in_vs").alias("has_vs"))


def with_subjects(df: DataFrame, code: str, subjects: DataFrame, studies: DataFrame | None = None,
                  scope: tuple[str, ...] = (), narrow: bool = False) -> DataFrame:
    """A domain's rows with what is known about their subject, and within a scope about their study.

    ``narrow`` keeps only the identifier and the date that the cross checks read, for a join that
    moves the rows.
    """
    if code == "EX" and "EXSTDTC" in df.columns:
        last = _last_dose(df).alias("last_dose")
    else:
        last = F.lit(None).cast("date").alias("last_dose")
    dates = {"VS": "VSDTC", "AE": "AESTDTC"}
    keep = [c for c in (ROW_INDEX, "USUBJID", dates.get(code)) if c in df.columns]
    events = df.select(*([*scope, *keep] if narrow else ["*"]), subject(), last)
    joined = lookup_join(events, subjects, [*scope, SUBJECT], "left")
    return joined if studies is None else lookup_join(joined, studies, list(scope), "left")


def by_subject(rules: list[Rule]) -> bool:
    """Whether the rules look at the subject of a row only, not at its dates."""
    return all(r.requires == ("USUBJID",) for r in rules)


def suspect_findings(df: DataFrame, code: str, rules: list[Rule], subjects: DataFrame, studies: DataFrame | None,
                     scope: tuple[str, ...], own: list[Rule] | None = None) -> DataFrame:
    """The findings of rules that look at subjects only (see :func:`by_subject`), and of the row rules ``own``.

    The rules are tested on the subjects that the subject table has for the domain, and only those that break one go back to
    the rows, as a stored table.  If it is small, it is shipped to the one scan that tests all rules, and the rows stay where
    they are; else the rows are shuffled with their identifiers only.
    """
    known = subjects.where(occurs(code))
    if studies is not None:
        known = lookup_join(known, studies, list(scope), "left")
    facts = [c for c in ("in_dm", "in_vs", "has_dm", "has_vs") if c in known.columns]
    broken = " OR ".join(f"coalesce({r.predicate}, false)" for r in rules)
    suspects = written(known.where(broken).select(*scope, SUBJECT, *facts))
    if own and planned_bytes(suspects) <= broadcast_limit(suspects):
        marked = lookup_join(df.select("*", subject()), suspects.withColumn("_suspect", F.lit(True)), [*scope, SUBJECT], "left")
        asked = [replace(r, predicate=f"_suspect AND ({r.predicate})") for r in rules]
        return evaluate(marked, [*own, *asked], domain=code, scope=scope)
    joined = lookup_join(_events(df, scope), suspects, [*scope, SUBJECT], "inner")
    found = evaluate(joined, rules, domain=code, scope=scope)
    return union_findings([evaluate(df, own, domain=code, scope=scope), found]) if own else found
