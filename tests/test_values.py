import math

import pytest
from pyspark.sql import functions as F

from clinisieve.functions import text
from clinisieve.functions import values as v

DATES = {
    "2024-01-05": "2024-01-05", "2024-1-5": "2024-01-05", "2024-02-29": "2024-02-29", "2023-02-29": None,
    "2024-05": None, "2024": None, "20240105": None, "2024-01-05T10:00": None, " 2024-01-05": None,
    "2024-01-05 ": None, "2024-01-05\n": None, "2024-13-01": None, "05/05/2024": None, "": None, "UNK": None,
    "1677-09-21": None, "1677-09-22": "1677-09-22", "1677-9-30": "1677-09-30", "1677-12-1": "1677-12-01",
    "2262-04-11": "2262-04-11", "2262-04-12": None, "2262-4-9": "2262-04-09", "2263-01-01": None,
    "1678-01-01": "1678-01-01", "1700-01-01": "1700-01-01", "2261-12-31": "2261-12-31", "0001-01-01": None,
}
NUMBERS = {
    "1": 1.0, " 12.50 ": 12.5, "-3": -3.0, "+4": 4.0, ".5": 0.5, "5.": 5.0, "1e5": 1e5, "1E-3": 1e-3, "1d": None,
    "1f": None, "abc": None, "": None, " ": None, "1,5": None, "inf": math.inf, "-Infinity": -math.inf,
    "1e400": None, "NaN": None, "0x10": None, "--1": None, "12345678901234567890": 12345678901234567890.0,
}


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([(t,) for t in {**DATES, **NUMBERS}], "t string")
    got = {r.t: r for r in df.select("t", v.iso_date("t").cast("string").alias("d"), v.number("t").alias("n")).collect()}
    assert {t: got[t].d for t in DATES} == DATES
    assert {t: got[t].n for t in NUMBERS} == NUMBERS


def test_blank_and_clean(spark):
    cases = {None: ("", True), "": ("", True), "  ": ("", True), "\t x ": ("x", False), "nan": ("nan", True),
             " nan ": ("nan", True), "NaN": ("NaN", False), "　é ": ("é", False), "a b": ("a b", False)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.c, r.b) for r in df.select("t", v.clean("t").alias("c"), v.blank("t").alias("b")).collect()}
    assert got == cases


def test_decimal_comma(spark):
    df = spark.createDataFrame([("120,5",), ("120.5",), ("1,2,3",)], "t string")
    assert [r[0] for r in df.select(v.number_comma("t")).collect()] == [120.5, 120.5, None]


def test_csv_null_tokens_match_exactly(spark):
    df = spark.createDataFrame([("NA", 1), (" NA ", 2), ("null", 3), ("x", 4)], "t string, n int")
    assert [r.t for r in v.nulls_from_tokens(df).orderBy("n").collect()] == [None, " NA ", None, "x"]


@pytest.mark.parametrize("limit", [90, 200])
def test_shortened_messages_keep_their_value(spark, limit):
    def expected(message):
        if len(message) <= limit:
            return message
        at = message.rfind(" (found: ")
        if at < 0:
            return message[:limit].rstrip() + "…"
        tail = message[at:]
        return message[:max(limit - len(tail), 20)].rstrip() + "…" + tail
    messages = ["short", "w " * 120, "rule text " * 30 + " (found: 'v')", "a (found: 'x') b (found: '" + "y" * 300 + "')",
                "line\nbreak " * 40 + " (found: 'q\nr')"]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = {r.m: r.s for r in df.select("m", text.shorten_message(F.col("m"), limit).alias("s")).collect()}
    assert got == {m: expected(m) for m in messages}


def test_numbers_are_spelled_with_the_fewest_digits(spark):
    values = [0.0, 1.0, 1e7, 12345678.9, 1e15, 1e16, 1e-3, 1e-4, 1.25e-4, 1e-5, 142.23333333333332, -12345678901.25,
              math.inf, 2.5e-300]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(text.double_text(F.col("x"))).collect()] == [repr(x) for x in values]
