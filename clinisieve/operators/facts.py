"""One aggregation over all domains that gathers what later steps need to know per subject.

The facts are kept per identifier as it is written.  The feature frame uses them as they are; the
cross-domain rules use them merged by cleaned identifier.  So every domain is read once for this,
whatever the number of rules and features.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.functions import values as v
from clinisieve.operators.subjects import SUBJECT, choose_exit, is_disposition, subject

# The test codes that feed a feature.
SYSBP_TEST, ALT_TEST, QT_TESTS = "SYSBP", "ALT", ("QTCF", "QT")

KEY = "USUBJID"

# fact -> (SQL type, how a subject's values are combined)
PRESENCE = {
    "in_dm": ("boolean", F.max), "in_vs": ("boolean", F.max),
    "vs_min": ("date", F.min), "vs_max": ("date", F.max),
    "cm_min": ("date", F.min), "cm_max": ("date", F.max),
    "exit_event": ("date", F.min), "exit_any": ("date", F.min),
}
FEATURE_FACTS = {
    "SYSBP": ("double", F.avg), "VSDTC": ("date", F.min), "DOSE": ("double", F.avg),
    "ALT": ("double", F.avg), "QTCF": ("double", F.avg), "QS_SCORE": ("double", F.avg),
    "PR_COUNT": ("int", F.count),
}


def _has(df: DataFrame | None, *columns: str) -> bool:
    return df is not None and {KEY, *columns} <= set(df.columns)


def full_date(column: str) -> Column:
    """The date of a text that is exactly how that date is written: accepted, and with all ten characters."""
    return F.when(F.octet_length(column) == 10, v.iso_date(column))


def occurs(code: str) -> str:
    """The fact that a subject has rows of a domain."""
    return f"in_{code.lower()}"


def presence(frames: dict[str, DataFrame], seen: tuple[str, ...] = ()) -> dict[str, dict[str, Column]]:
    """domain -> what a row says about where its subject occurs and when; ``seen`` names further domains to tell."""
    dm, vs, cm, ds = (frames.get(c) for c in ("DM", "VS", "CM", "DS"))
    out: dict[str, dict[str, Column]] = {}
    if _has(dm):
        out["DM"] = {"in_dm": F.lit(True)}
    if _has(vs):
        out["VS"] = {"in_vs": F.lit(True)}
        if _has(vs, "VSDTC"):
            out["VS"] |= {"vs_min": v.iso_date("VSDTC"), "vs_max": v.iso_date("VSDTC")}
    if _has(cm, "CMSTDTC", "CMENDTC"):
        start = v.iso_date("CMSTDTC")
        out["CM"] = {"cm_min": start, "cm_max": F.when(start.isNotNull(), v.iso_date("CMENDTC"))}
    if _has(ds, "DSSTDTC"):
        day = v.iso_date("DSSTDTC")
        out["DS"] = {"exit_event": F.when(is_disposition(ds), day), "exit_any": day}
    for code in seen:
        if _has(frames.get(code)):
            out.setdefault(code, {})[occurs(code)] = F.lit(True)
    return out


def contributions(frames: dict[str, DataFrame]) -> dict[str, dict[str, Column]]:
    """domain -> what a row contributes to its subject's features.

    Identifiers and test codes are compared as they are written.
    """
    vs, ex, lb, eg, qs, pr = (frames.get(c) for c in ("VS", "EX", "LB", "EG", "QS", "PR"))
    out: dict[str, dict[str, Column]] = {}
    if _has(vs, "VSTESTCD", "VSORRES"):
        out["VS"] = {"SYSBP": F.when(F.col("VSTESTCD") == SYSBP_TEST, v.number("VSORRES"))}
        if _has(vs, "VSDTC"):
            out["VS"]["VSDTC"] = full_date("VSDTC")
    if _has(ex, "EXDOSE"):
        out["EX"] = {"DOSE": v.number("EXDOSE")}
    if _has(lb, "LBTESTCD") and (_has(lb, "LBSTRESN") or _has(lb, "LBORRES")):
        source = "LBSTRESN" if _has(lb, "LBSTRESN") else "LBORRES"
        out["LB"] = {"ALT": F.when(F.col("LBTESTCD") == ALT_TEST, v.number(source))}
    if _has(eg, "EGTESTCD", "EGORRES"):
        out["EG"] = {"QTCF": F.when(F.col("EGTESTCD").isin(*QT_TESTS), v.number("EGORRES"))}
    if _has(qs, "QSSTRESN"):
        out["QS"] = {"QS_SCORE": v.number("QSSTRESN")}
    if _has(pr):
        out["PR"] = {"PR_COUNT": F.lit(1)}
    return out


def _telling(columns: dict[str, Column]) -> Column | None:
    """Which rows of a domain say anything, where a feature of some tests is all that it contributes."""
    return {"ALT": F.col("LBTESTCD") == ALT_TEST, "QTCF": F.col("EGTESTCD").isin(*QT_TESTS)}.get(next(iter(columns))) if len(columns) == 1 else None


def subject_facts(frames: dict[str, DataFrame], scope: tuple[str, ...] = (), *,
                  with_presence: bool = True, features: set[str] | None = None, seen: tuple[str, ...] = ()) -> DataFrame:
    """One row per written identifier with its facts; ``features`` names those wanted (all if None).

    Each domain is aggregated by itself, since a subject's rows of a large domain are spread over all tasks and
    so reach the shuffle nearly one by one: as narrow as the domain's facts, not with a place for those of all others.
    Then the domains' rows per subject are put together; a fact comes from one domain, so nothing is summed twice.

    Dates and numbers are combined in a hash aggregation before the shuffle.  The first visit is
    the smallest text, which would turn that into a sort of all rows; properly written dates,
    whose order is that of their texts, therefore go through it as dates, and only the few other
    texts are sorted, on their own.
    """
    known = {**PRESENCE, **{occurs(code): ("boolean", F.max) for code in seen}}
    sources: dict[str, dict[str, Column]] = {}
    for given in ([presence(frames, seen)] if with_presence else []) + [contributions(frames)]:
        for code, columns in given.items():
            chosen = {c: e for c, e in columns.items()
                      if c in known or features is None or c in features}
            if chosen:
                sources[code] = sources.get(code, {}) | chosen
    kinds = {c: kind for c, kind in {**known, **FEATURE_FACTS}.items()
             if any(c in columns for columns in sources.values())}
    parts = []
    for code, columns in sources.items():
        telling = _telling(columns)
        rows = frames[code] if telling is None else frames[code].where(telling)
        rows = rows.select(*scope, KEY, *[e.cast(kinds[c][0]).alias(c) for c, e in columns.items()])
        parts.append(rows.groupBy(*scope, KEY).agg(*[kinds[c][1](c).alias(c) for c in columns]))
    whole = {c: F.coalesce(F.max(c), F.lit(0)) if how is F.count else F.max(c) for c, (_, how) in kinds.items()}
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(*scope, KEY).agg(
        *[e.alias(c) for c, e in whole.items()])
    if "VSDTC" not in kinds:
        return table
    others = frames["VS"].filter(F.col(KEY).isNotNull() & F.col("VSDTC").isNotNull()
                                 & full_date("VSDTC").isNull())
    others = others.groupBy(*scope, KEY).agg(F.min("VSDTC").alias("_other"))
    return table.join(others, [*scope, KEY], "left").withColumn(
        "VSDTC", F.least(F.col("VSDTC").cast("string"), F.col("_other"))).drop("_other")


def subject_features(facts: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The features of the facts, for identifiers that are there."""
    named = [c for c in FEATURE_FACTS if c in facts.columns]
    return facts.filter(F.col(KEY).isNotNull()).select(*scope, KEY, *named)


def subject_table(facts: DataFrame, frames: dict[str, DataFrame], scope: tuple[str, ...] = ()) -> DataFrame:
    """Where each cleaned identifier occurs and when, one row per subject; unknown is null."""
    kinds = PRESENCE | {c: ("boolean", F.max) for c in facts.columns if c in map(occurs, frames)}
    known = {c: F.col(c) if c in facts.columns else F.lit(None).cast(kind) for c, (kind, _) in kinds.items()}
    table = facts.select(*scope, subject(), *[e.alias(c) for c, e in known.items()]).groupBy(
        *scope, SUBJECT).agg(*[how(c).alias(c) for c, (_, how) in kinds.items()])
    if _has(frames.get("DS"), "DSSTDTC"):
        return choose_exit(table, frames["DS"], scope)
    return table.withColumn("ds_exit", F.lit(None).cast("date")).drop("exit_event", "exit_any")
