"""Declarative rules, and their evaluation in one pass over a table."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve.findings import COLUMNS, SCHEMA, SDTM_RULE
from clinisieve.functions import text
from clinisieve.functions import values as v

ROW_INDEX = "row_index"

# The derived forms of a column ``X`` that rule texts may name as ``X__clean`` and so on.
FORMS = {"clean": v.clean_sql, "date": v.date_sql, "number": v.number_sql, "comma": v.comma_number_sql}
_FORM = re.compile(r"\b(\w+?)__(" + "|".join(FORMS) + r")\b")


@dataclass(frozen=True)
class Rule:
    """A condition that makes a row a finding.

    ``predicate`` and ``evidence`` are Spark SQL expressions over the table's columns and their
    derived forms (``AGE__number``, ``SEX__clean``, ``VSDTC__date``, ``VSORRES__comma``).
    ``requires`` names the columns the rule reads; without one of them the rule does not apply.
    ``absent`` names columns that must not be there (for the variant of a rule that covers their
    absence).  ``domain`` and ``finding_type`` override those of the table being checked.
    """

    rule_id: str
    severity: str
    field: str
    message: str
    predicate: str
    evidence: str
    requires: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()
    domain: str | None = None
    finding_type: str | None = None

    def applies_to(self, columns: Iterable[str]) -> bool:
        return set(self.requires) <= set(columns) and not set(self.absent) & set(columns)


def listed(values: Iterable[str]) -> str:
    """A SQL list of text literals."""
    return "(" + ", ".join(v.literal(x) for x in values) + ")"


def is_blank(column: str) -> str:
    return f"{column}__clean IN ('', 'nan')"


# --- the rule families ----------------------------------------------------------------------

def must_be_filled(rule_id: str, severity: str, column: str) -> Rule:
    return Rule(rule_id, severity, column, f"{column} is required and must be non-empty.",
                is_blank(column), column, (column,))


def must_be_date(rule_id: str, severity: str, column: str) -> Rule:
    return Rule(rule_id, severity, column, f"{column} should be ISO date YYYY-MM-DD.",
                f"{column} IS NOT NULL AND {column}__date IS NULL", column, (column,))


def must_be_number(rule_id: str, severity: str, column: str) -> Rule:
    return Rule(rule_id, severity, column, f"{column} should be numeric.",
                f"{column} IS NOT NULL AND {column}__number IS NULL", column, (column,))


def must_be_in(rule_id: str, severity: str, column: str, allowed: list[str], *,
               wording: str = "should", strip: bool = True, show_stripped: bool = False) -> Rule:
    compared = f"{column}__clean" if strip else column
    return Rule(rule_id, severity, column, f"{column} {wording} be one of: {allowed}.",
                f"{column} IS NOT NULL AND {compared} NOT IN {listed(allowed)}",
                f"{column}__clean" if show_stripped else column, (column,))


def must_be_ordered(rule_id: str, severity: str, start: str, end: str) -> Rule:
    return Rule(rule_id, severity, f"{start}/{end}", f"{start} must be on or before {end}.",
                f"{start}__date > {end}__date", f"{start} || ' > ' || {end}", (start, end))


def result_must_be_number(rule_id: str, severity: str, test: str, result: str,
                          tests: list[str]) -> Rule:
    return Rule(rule_id, severity, result, f"{result} should be numeric for this {test}.",
                f"{result} IS NOT NULL AND {result}__comma IS NULL"
                f" AND {test}__clean IN {listed(tests)}", result, (test, result))


def unit_must_fit(rule_id: str, severity: str, test: str, unit: str,
                  units: dict[str, list[str]]) -> Rule:
    branches = " ".join(
        f"WHEN '{code}' THEN {unit}__clean NOT IN {listed(allowed)}" for code, allowed in units.items())
    return Rule(rule_id, severity, unit, f"{unit} unit is not consistent with {test}.",
                f"{unit} IS NOT NULL AND CASE {test}__clean {branches} ELSE false END",
                f"{test}__clean || ' / ' || {unit}__clean", (test, unit))


# --- evaluation -----------------------------------------------------------------------------

def with_forms(df: DataFrame, texts: Iterable[str]) -> DataFrame:
    """Add the derived forms that the expressions name, each worked out once per row."""
    needed = sorted({m.groups() for t in texts for m in _FORM.finditer(t)})
    return df.selectExpr("*", *[f"{FORMS[form](c)} AS {c}__{form}" for c, form in needed])


def _guarded(rule: Rule, present: str | None) -> str:
    """With per-row column presence, a rule only fires where its columns are there."""
    checks = [f"coalesce({rule.predicate}, false)"]
    if present is not None:
        checks += [f"array_contains({present}, '{c}')" for c in rule.requires]
        checks += [f"NOT array_contains({present}, '{c}')" for c in rule.absent]
    return " AND ".join(checks)


def evaluate(df: DataFrame, rules: list[Rule], *, domain: str, finding_type: str = SDTM_RULE,
             scope: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """One findings row per (row, rule) that fires.

    All rules are tested in a single scan: each row yields the list of fired rules, which is
    exploded; the constant columns are looked up from the rule number afterwards, so a row only
    carries a number and its evidence.  Nothing is shuffled.  (The outer form of explode keeps
    Spark from testing the list's size first, which would work out every rule twice.)

    ``df`` holds its row position in ``row_index`` (null when it has none).  ``present`` names an
    array column of the column names a row's source has, for tables merged from several sources.
    """
    if present is None:
        rules = [r for r in rules if r.applies_to(df.columns)]
    if not rules:
        return df.sparkSession.createDataFrame([], SCHEMA).select(
            *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in scope], *COLUMNS)

    row_index = ROW_INDEX if ROW_INDEX in df.columns else "NULL"
    usubjid = "coalesce(CAST(USUBJID AS STRING), '')" if "USUBJID" in df.columns else "''"
    keep = [*scope, f"CAST({row_index} AS BIGINT) AS {ROW_INDEX}", f"{usubjid} AS usubjid"]
    rows = with_forms(df, [t for r in rules for t in (r.predicate, r.evidence)])
    # A test on columns as they are goes to the scan; derived forms are not to be repeated there.
    if len(rules) == 1 and not _FORM.search(rules[0].predicate):
        hits = rows.filter(_guarded(rules[0], present)).selectExpr(
            *keep, "0 AS n", f"coalesce(CAST({rules[0].evidence} AS STRING), '') AS evidence")
    else:
        fired = ", ".join(
            f"CASE WHEN {_guarded(r, present)} THEN"
            f" named_struct('n', {i}, 'evidence', coalesce(CAST({r.evidence} AS STRING), '')) END"
            for i, r in enumerate(rules))
        hits = (rows.selectExpr(*keep, f"array({fired}) AS fired")
                .selectExpr(*scope, ROW_INDEX, "usubjid", "inline_outer(fired) AS (n, evidence)")
                .filter("n IS NOT NULL"))

    def constant(attribute: str, default: str = "") -> str:
        texts = [getattr(r, attribute) or default for r in rules]
        if len(set(texts)) == 1:
            return v.literal(texts[0])
        return f"array({', '.join(map(v.literal, texts))})[n]"

    return hits.selectExpr(
        *scope,
        f"{constant('finding_type', finding_type)} AS finding_type",
        f"{constant('rule_id')} AS rule_id",
        f"{constant('severity')} AS severity",
        f"{constant('domain', domain)} AS domain",
        f"{constant('field')} AS field",
        f"{text.with_found_sql(constant('message'), 'evidence')} AS message",
        ROW_INDEX,
        "usubjid",
        "evidence",
    )
