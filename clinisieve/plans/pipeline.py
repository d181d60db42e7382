"""Full validation of a study, of many studies at once, and of a flat feature file."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from clinisieve.findings import COLUMNS, empty_findings, union_findings
from clinisieve.functions.text import as_texts
from clinisieve.operators.cross import by_subject, study_checks, study_presence, suspect_findings, with_subjects
from clinisieve.operators.domains import DOMAINS, missing_columns, row_rules, table_findings
from clinisieve.operators.facts import subject_facts, subject_table
from clinisieve.operators.features import apply_ranges, flagged_features, range_findings, with_texts
from clinisieve.operators.joins import broadcast_limit, planned_bytes
from clinisieve.operators.outliers import detect_outliers, detect_study_outliers, outlier_findings
from clinisieve.operators.rules import ROW_INDEX, evaluate
from clinisieve.sources.files import read_dataset
from clinisieve.sources.scratch import cleared, written
from clinisieve.sources.sinks import store_findings


def non_empty(frames: dict[str, DataFrame], scope: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The domains that have rows, as texts, in reporting order; a table is only read up to its first row."""
    given = [code for code in DOMAINS if code in frames]
    with ThreadPoolExecutor(max(len(given), 1)) as pool:
        empty = list(pool.map(lambda code: frames[code].isEmpty(), given))
    return {code: as_texts(frames[code], ROW_INDEX, *scope) for code, nothing in zip(given, empty) if not nothing}


def domain_findings(frames: dict[str, DataFrame], facts: DataFrame | None,
                    scope: tuple[str, ...] = ()) -> list[DataFrame]:
    """Row rules and cross-domain rules of the given, non-empty domains.

    The written subject table's size decides how they run.  A small one is shipped to every task,
    and a domain's row rules and cross-domain rules are tested together in a single scan that
    moves no rows.  Otherwise rules that look at subjects only are tested on the domain's subjects, of which those that
    break one go back to the rows; for the others only identifiers and dates take part in a shuffled join, and the row
    rules have a scan of their own, still moving nothing.
    """
    cross, parts = study_checks(frames, scope)
    subjects, studies, ship = None, None, False
    if cross:
        subjects = written(subject_table(facts, frames, scope))
        studies = written(study_presence(subjects, scope)) if scope else None
        ship = planned_bytes(subjects) <= broadcast_limit(subjects)
    for code, df in frames.items():
        lacking = missing_columns(df, code, scope)
        own = row_rules(df, code) if lacking is None else []
        parts += [lacking] if lacking is not None else table_findings(df, code, scope)
        between = cross.get(code, [])
        if between and ship:
            joined = with_subjects(df, code, subjects, studies, scope)
            parts.append(evaluate(joined, own + between, domain=code, scope=scope))
            continue
        if between and by_subject(between):
            parts.append(suspect_findings(df, code, between, subjects, studies, scope, own))
            continue
        if own:
            parts.append(evaluate(df, own, domain=code, scope=scope))
        if between:
            joined = with_subjects(df, code, subjects, studies, scope, narrow=True)
            parts.append(evaluate(joined, between, domain=code, scope=scope))
    return parts


def _rule_findings(frames: dict[str, DataFrame], scope: tuple[str, ...] = ()
                   ) -> tuple[list[DataFrame], DataFrame | None]:
    """All findings but the outliers, and the stored feature frame (None without demographics)."""
    identified = [code for code, df in frames.items() if "USUBJID" in df.columns]
    facts = None
    if {"DM", "VS"} & set(identified):
        asked = tuple(code for code, rules in study_checks(frames, scope)[0].items() if by_subject(rules))
        facts = written(subject_facts({code: frames[code] for code in identified}, scope, seen=asked))
    parts = domain_findings(frames, facts, scope)
    if "DM" not in identified:
        return parts, None
    features = flagged_features(frames, scope, facts)
    return [*parts, range_findings(features, scope)], features


def _whole(parts: list[DataFrame], frames: dict[str, DataFrame], scope: tuple[str, ...] = ()) -> DataFrame:
    if not parts:
        return empty_findings(next(iter(frames.values())).sparkSession)
    return union_findings([p.select(*scope, *COLUMNS) for p in parts])


def validate_all(frames: dict[str, DataFrame], outliers: bool = True) -> DataFrame:
    """Every finding of one study.  ``frames`` maps domain codes to tables."""
    parts, features = _rule_findings(non_empty(frames))
    if outliers and features is not None:
        parts.append(outlier_findings(detect_outliers(features)))
    return _whole(parts, frames)


def validate_job(frames: dict[str, DataFrame], scope: tuple[str, ...], outliers: bool = True) -> DataFrame:
    """Every finding of many studies in one job; ``scope`` names the columns of a study.

    All keys, windows, study-wide switches and outliers hold within a study.
    """
    parts, features = _rule_findings(non_empty(frames, scope), scope)
    if outliers and features is not None:
        parts.append(outlier_findings(detect_study_outliers(features, scope), scope))
    return _whole(parts, frames, scope)


def validate_generic(df: DataFrame, outliers: bool = True) -> DataFrame:
    """Range rules and outliers of a flat file with one row per subject."""
    flagged = with_texts(apply_ranges(df))
    if not outliers:
        return range_findings(flagged)
    flagged = written(flagged)
    return union_findings([range_findings(flagged), outlier_findings(detect_outliers(flagged))])


def run_job(spark: SparkSession, datasets: list[tuple[str, str, str]], store: str, *,
            tenant_id: str, job_id: str, study_id: str) -> dict[str, int]:
    """Validate the files of one job, store the findings, and count them by severity.

    ``datasets`` lists (domain, format, path); of several files of a domain the last one counts.  A job
    that is run again replaces its findings; one that fails leaves those of an earlier run.
    """
    frames: dict[str, DataFrame] = {}
    parts: list[DataFrame] = []
    with cleared(spark):
        for domain, file_format, path in datasets:
            table, found = read_dataset(spark, path, file_format, domain)
            if table is not None:
                frames[domain] = written(table)  # a file is parsed once, and read by many steps
            if found is not None:
                parts.append(found.select(*COLUMNS))
        if frames:
            parts.append(validate_all(frames))
        return store_findings(union_findings(parts or [empty_findings(spark)]), store, tenant_id, job_id, study_id)
