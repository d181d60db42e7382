"""The per-subject feature frame, its validity flags, and the findings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.functions.text import as_texts
from clinisieve.functions import text
from clinisieve.functions import values as v
from clinisieve.operators.facts import KEY, contributions, subject_facts, subject_features
from clinisieve.operators.joins import has_rows, lookup_join
from clinisieve.operators.rules import ROW_INDEX, Rule, evaluate
from clinisieve.sources.scratch import written

# The features, those that a flat file must have, and the inclusive valid ranges.
FEATURES = ("AGE", "SYSBP", "DOSE", "ALT", "QTCF", "QS_SCORE", "PR_COUNT")
REQUIRED = ("AGE", "SYSBP", "DOSE", "VSDTC")
RANGES: dict[str, tuple[float | None, float | None]] = {
    "AGE": (18.0, 120.0), "SYSBP": (90.0, 180.0), "DOSE": (0.001, None)}

AGE_WHOLE = "_age_whole"


def _feature_rows(frames: dict[str, DataFrame], scope: tuple[str, ...],
                  facts: DataFrame | None) -> DataFrame:
    dm = frames["DM"]
    has_age = "AGE" in dm.columns
    age = v.number("AGE") if has_age else F.lit(None).cast("double")
    whole = F.coalesce(v.written_as_integer("CAST(AGE AS STRING)"), F.lit(False)) if has_age else F.lit(False)
    spine = dm.select(*scope, *[c for c in (ROW_INDEX,) if c in dm.columns], KEY,
                      age.alias("AGE"), whole.alias(AGE_WHOLE))
    if contributions(frames):
        if facts is None:
            facts = subject_facts(frames, scope, with_presence=False)
        spine = lookup_join(spine, subject_features(facts, scope), [*scope, KEY], "left")
    if "PR_COUNT" in spine.columns:
        spine = spine.withColumn("PR_COUNT", F.coalesce(F.col("PR_COUNT").cast("double"), F.lit(0.0)))
    missing = {c: F.lit(None).cast("string" if c == "VSDTC" else "double")
               for c in REQUIRED if c not in spine.columns}
    return spine.withColumns(missing) if missing else spine


def feature_frame(frames: dict[str, DataFrame], scope: tuple[str, ...] = (),
                  facts: DataFrame | None = None) -> DataFrame:
    """One row per demographics row, duplicates included, with the subject's features.

    A required feature whose domain is missing is null throughout; an optional one is left out.
    A subject without procedures has a count of 0 if there is a procedures domain.
    """
    rows = _feature_rows({code: as_texts(df, ROW_INDEX, *scope) for code, df in frames.items()}, scope, facts)
    order = [*scope, ROW_INDEX, KEY, "AGE", "SYSBP", "VSDTC", "DOSE", "ALT", "QTCF", "QS_SCORE", "PR_COUNT"]
    return rows.select(*[c for c in order if c in rows.columns])


def flagged_features(frames: dict[str, DataFrame], scope: tuple[str, ...] = (),
                     facts: DataFrame | None = None) -> DataFrame:
    """The feature frame with validity flags and the spelling of each feature, as a stored table.

    Within a study, ages are spelled without a fraction when every one is written as an integer,
    and counts when no subject lacks one.
    """
    rows = written(_feature_rows(frames, scope, facts))
    count = F.col("PR_COUNT") if "PR_COUNT" in rows.columns else F.lit(None).cast("double")
    if scope:
        forms = rows.groupBy(*scope).agg(
            F.bool_and(AGE_WHOLE).alias("_ages_whole"), (F.min(count) > 0).alias("_counts_whole"))
        rows = lookup_join(rows, forms, list(scope), "left")
        whole = {"AGE": F.col("_ages_whole"), "PR_COUNT": F.col("_counts_whole")}
    else:
        whole = {"AGE": ~has_rows(rows.filter(~F.col(AGE_WHOLE))),
                 "PR_COUNT": ~has_rows(rows.filter(count == 0))}
    return with_texts(apply_ranges(rows), whole).drop(AGE_WHOLE, "_ages_whole", "_counts_whole")


# --- flags and findings -----------------------------------------------------------------------------


def _as_number(df: DataFrame, column: str) -> Column:
    return v.number(column) if df.schema[column].dataType.typeName() == "string" \
        else F.col(column).cast("double")


def apply_ranges(df: DataFrame) -> DataFrame:
    """Add ``X_num`` for every feature, ``X_valid`` (1 or 0) per range, and ``date_valid``.

    A missing or unreadable value is not valid; of a date only its presence is checked.
    """
    numbers = {f"{c}_num": _as_number(df, c) for c in FEATURES if c in df.columns}
    out = df.withColumns(numbers) if numbers else df
    flags = {}
    for c, (low, high) in RANGES.items():
        if f"{c}_num" in out.columns:
            inside = F.col(f"{c}_num").isNotNull()
            if low is not None:
                inside = inside & (F.col(f"{c}_num") >= low)
            if high is not None:
                inside = inside & (F.col(f"{c}_num") <= high)
            flags[f"{c}_valid"] = F.coalesce(inside, F.lit(False)).cast("int")
    if "VSDTC" in out.columns:
        flags["date_valid"] = F.col("VSDTC").isNotNull().cast("int")
    return out.withColumns(flags) if flags else out


def with_texts(df: DataFrame, whole: dict[str, Column | bool] | None = None) -> DataFrame:
    """Add ``X__text``, the spelling of each feature in evidence.

    Text stays as written.  A number is spelled with a fraction unless ``whole`` says that its
    column holds integers throughout.
    """
    whole = whole or {}
    texts = {}
    for c in FEATURES:
        if c in df.columns:
            kind = df.schema[c].dataType.typeName()
            if kind == "string":
                texts[f"{c}__text"] = F.col(c)
            elif kind in ("integer", "long", "short", "byte"):
                texts[f"{c}__text"] = F.col(c).cast("string")
            else:
                texts[f"{c}__text"] = text.feature_text(F.col(c).cast("double"), whole.get(c, False))
    return df.withColumns(texts) if texts else df


def range_rules(columns: list[str]) -> list[Rule]:
    rules = [
        Rule(f"GENERIC_{c}_001", "MED", c, f"{c} failed validation rule.",
             f"{c}_valid = 0", f"{c}__text", (f"{c}_valid",)) for c in RANGES]
    rules.append(Rule("GENERIC_DATE_001", "MED", "date", "date failed validation rule.",
                      "date_valid = 0", "''", ("date_valid",)))
    return [r for r in rules if r.applies_to(columns)]


def range_findings(flagged: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a frame that went through :func:`apply_ranges` and :func:`with_texts`."""
    return evaluate(flagged, range_rules(flagged.columns), domain="GENERAL", scope=scope)


def evidence_list(df: DataFrame) -> Column:
    """``AGE=23, SYSBP=142.5`` over the features that a row has."""
    return text.name_value_list([
        (c, F.col(c), F.col(f"{c}__text")) for c in FEATURES if c in df.columns])
