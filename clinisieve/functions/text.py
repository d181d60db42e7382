"""Texts built from values: messages, evidence, number spellings, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.functions.values import WHITESPACE, literal

# How a message names the value it complains about.
FOUND_PREFIX = " (found: '"
FOUND_SUFFIX = "')"
FOUND_MARKER = " (found: "
ELLIPSIS = "…"
MIN_PREFIX = 20
EVIDENCE_LIMIT = 120
REPORT_MESSAGE_LIMIT = 200


def with_found_sql(message: str, evidence: str) -> str:
    """SQL that adds the offending value to a rule text, unless there is none."""
    return (f"CASE WHEN {evidence} = '' THEN {message} "
            f"ELSE concat({message}, {literal(FOUND_PREFIX)}, {evidence}, {literal(FOUND_SUFFIX)}) END")


def double_text(c: Column) -> Column:
    """A double spelled with the fewest digits: plain from 1e-4 up to 1e16, else with an exponent."""
    raw = c.cast("string")
    # Spark switches to an exponent earlier; a decimal of the same digits gives the plain form.
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(\d)", "e+$1")
    exponent = F.regexp_replace(F.lower(exponent), r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(~raw.contains("E") & ~raw.contains("y"), raw)
        .when(raw.contains("y"), F.replace(raw, F.lit("Infinity"), F.lit("inf")))
        .when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain)
        .otherwise(exponent)
    )


def as_texts(df: DataFrame, *keep: str) -> DataFrame:
    """Columns of numbers, truth values and days as texts, as a reader without types would have them.

    Whole numbers have no fraction, others the fewest digits; not-a-number is null; a time is its day.
    Texts, nested columns and those named in ``keep`` stay as they are.
    """
    def spelled(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if field.name in keep or isinstance(field.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)):
            return c
        if isinstance(field.dataType, T.FloatType):
            c = c.cast("string").cast("double")  # the digits that the float is written with
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), double_text(c)).alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        return c.cast("string").alias(field.name)
    return df.select(*[spelled(f) for f in df.schema])


def feature_text(c: Column, whole_numbers: Column | bool) -> Column:
    """A feature value: without a fraction where its whole column holds integers."""
    flag = F.lit(whole_numbers) if isinstance(whole_numbers, bool) else whole_numbers
    return F.when(flag, c.cast("decimal(38,0)").cast("string")).otherwise(double_text(c))


def name_value_list(pairs: list[tuple[str, Column, Column]]) -> Column:
    """``A=1, B=2`` over (name, value, text); a null value is left out."""
    return F.concat_ws(", ", *[
        F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), text)) for name, value, text in pairs
    ])


def shorten_message(message: Column, limit: int = 90) -> Column:
    """Cut a message to ``limit`` characters, but keep the value it ends with.

    The rule text in front of the last "(found: " is cut (to 20 characters at the least);
    a message without one is cut at the end.
    """
    def rstrip(c: Column) -> Column:
        return F.rtrim(c, F.lit(WHITESPACE))

    tail_pattern = r"(?s)^.*( \(found: .*)$"
    tail = F.regexp_extract(message, tail_pattern, 1)
    room = F.greatest(F.lit(limit) - F.length(tail), F.lit(MIN_PREFIX))
    return (
        F.when(F.length(message) <= limit, message)
        .when(tail == "", F.concat(rstrip(F.left(message, F.lit(limit))), F.lit(ELLIPSIS)))
        .otherwise(F.concat(rstrip(F.left(message, room)), F.lit(ELLIPSIS), tail))
    )


def report_line(severity: Column, domain: Column, rule_id: Column, field: Column,
                evidence: Column, message: Column) -> Column:
    return F.concat(
        F.lit("["), severity, F.lit("] "), domain, F.lit(" | "), rule_id, F.lit(" | "),
        field, F.lit("="), F.coalesce(evidence, F.lit("")), F.lit(" | "), message,
    )
