"""How a raw text value is cleaned, tested for blankness and parsed.

Everything here is a plain SQL expression over a text column, so a rule built from these stays
inside whole-stage code generation.  Each form comes as SQL text and as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space when a value is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The texts a CSV cell may hold to say "no value" (exact match).
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The accepted spellings of a date (1677-09-22 to 2262-04-11) and of a number.
DATE_PATTERN = (
    r"^((167[89]|16[89][0-9]|1[789][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[01])-[0-9]{1,2}-[0-9]{1,2}"
    r"|1677-(0?9-2[2-9]|0?9-30|1[0-2]-[0-9]{1,2})"
    r"|2262-(0?[1-3]-[0-9]{1,2}|0?4-(0?[0-9]|1[01])))\z"
)
SIMPLE_NUMBER_PATTERN = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?\z"
FINITE_NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*\z"
INFINITE_NUMBER_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*\z"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*\z"


def literal(value: str) -> str:
    """A SQL text literal."""
    return "'" + "".join(
        ch if " " <= ch <= "~" and ch not in "'\\" else f"\\u{ord(ch):04x}" for ch in value) + "'"


# The SQL of each derived form of a column.  Most values are ASCII and start and end with a character after the
# blank, so that stripping passes them on as they are; most dates have ten characters, whose order is that of the days,
# and are told without a pattern; most numbers are plain digits.
_CLEAN = (
    "CASE WHEN {c} >= '!' AND octet_length({c}) = length({c}) AND right({c}, 1) >= '!' THEN {c} "
    f"ELSE btrim(coalesce({{c}}, ''), {literal(WHITESPACE)}) END"
)
_DATE = (
    "CASE WHEN octet_length({c}) = 10 AND {c} >= '1677-09-22' AND {c} <= '2262-04-11' AND instr({c}, '-') = 5 "
    "AND locate('-', {c}, 8) = 8 AND right({c}, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN try_cast({c} AS DATE) "
    f"WHEN {{c}} RLIKE {literal(DATE_PATTERN)} THEN try_cast({{c}} AS DATE) END"
)
_NUMBER = (
    f"CASE WHEN {{c}} RLIKE {literal(SIMPLE_NUMBER_PATTERN)} THEN try_cast({{c}} AS DOUBLE) "
    f"WHEN {{c}} RLIKE {literal(FINITE_NUMBER_PATTERN)} "
    "THEN CASE WHEN abs(try_cast({c} AS DOUBLE)) < double('inf') THEN try_cast({c} AS DOUBLE) END "
    f"WHEN {{c}} RLIKE {literal(INFINITE_NUMBER_PATTERN)} THEN try_cast({{c}} AS DOUBLE) END"
)


def _fill(template: str, column: str) -> str:
    return template.replace("{c}", column)


def clean_sql(column: str) -> str:
    """Null becomes empty text; white space at both ends goes."""
    return _fill(_CLEAN, column)


def date_sql(column: str) -> str:
    """The date written as year-month-day, or null; unpadded parts are fine, partial dates are not."""
    return _fill(_DATE, column)


def number_sql(column: str) -> str:
    """The text as a double, or null when it is not a number.

    A finite spelling too large for a double is null; only a written ``inf`` is infinite.
    """
    return _fill(_NUMBER, column)


def comma_number_sql(column: str) -> str:
    """Like :func:`number_sql`, reading a decimal comma as a point."""
    return _fill(_NUMBER, f"replace({column}, ',', '.')")


def clean(column: str) -> Column:
    return F.expr(clean_sql(column))


def blank(column: str) -> Column:
    """True for null, empty, white-space-only and the text ``nan``."""
    return F.expr(f"({clean_sql(column)}) IN ('', 'nan')")


def iso_date(column: str) -> Column:
    return F.expr(date_sql(column))


def number(column: str) -> Column:
    return F.expr(number_sql(column))


def number_comma(column: str) -> Column:
    return F.expr(comma_number_sql(column))


def written_as_integer(column: str) -> Column:
    return F.expr(f"{column} RLIKE {literal(INTEGER_PATTERN)}")


def nulls_from_tokens(df: DataFrame) -> DataFrame:
    """Turn the CSV "no value" texts into nulls in every text column."""
    return df.select(*[
        F.when(~F.col(f"`{name}`").isin(*CSV_NULL_TOKENS), F.col(f"`{name}`")).alias(name)
        if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])
