"""What the validations share: dates told without a pattern, facts per domain, one scan for rules on rows and subjects."""

import pytest
from pyspark.sql import functions as F

from clinisieve.functions import values as v
from clinisieve.operators import cross, facts
from clinisieve.plans import pipeline

DATES = ["1995-03-07", "1995-3-7", "1995-03-7", "1995-3-07", "1995-03-0T", "1995-03-1T", "1995-03-1 ", " 1995-03-1", "1995-03-12 ", "1995-1-1T5",
         "1995-1-1 5", "16775-1-01", "01995-1-01", "1677-09-21", "1677-09-22", "1677-9-22", "2262-04-11", "2262-04-12", "2262-4-11", "1995-13-01",
         "1995-02-29", "1996-02-29", "1995-00-10", "1995-01-00", "+1995-1-01", "19950-1-01", "1995", "1995-03", "1995/03/07", "12-03-1995", "1995-03-०७",
         "1995--3-07", "1995-3--07", "-1995-3-07", "1995-03-07\n", "1995-03-1 ", "UNK", "", None, "1999      ", "1999-05   "]


def test_dates_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(d,) for d in DATES], "d string")
    pattern = F.expr(f"CASE WHEN d RLIKE {v.literal(v.DATE_PATTERN)} THEN try_cast(d AS DATE) END")
    written = F.expr(f"CASE WHEN CAST(CASE WHEN d RLIKE {v.literal(v.DATE_PATTERN)} THEN try_cast(d AS DATE) END AS STRING) = d THEN d END")
    got = rows.select("d", v.iso_date("d"), pattern, facts.full_date("d").cast("string"), written).collect()
    assert [tuple(r) for r in got if r[1] != r[2] or r[3] != r[4]] == []
    assert sum(r[1] is not None for r in got) == 9
    assert "octet_length" in v.date_sql("d")


def test_clean_is_stripping(spark):
    texts = ["a", "", " ", "a ", " a", " a", "a ", "é", "é ", "aé", "\x7f", "a\x7f", "\x1ca", "a\x01", "\x01", "~", "!", "a b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    stripped = F.expr(f"btrim(coalesce(t, ''), {v.literal(v.WHITESPACE)})")
    assert [tuple(r) for r in rows.select("t", v.clean("t"), stripped).collect() if r[1] != r[2]] == []


def test_facts_are_aggregated_per_domain(table):
    frames = {
        "DM": table("USUBJID", [("S1",), (None,)]),
        "VS": table("USUBJID VSTESTCD VSORRES VSDTC", [("S1", "SYSBP", "120", "2024-01-03"), ("S1", "SYSBP", "130", "2024-1-2"), (None, "TEMP", "37", "UNK")]),
        "PR": table("USUBJID", [("S1",), ("S1",), ("S2",), (None,)]),
        "RS": table("USUBJID", [("S3",), ("S3",)]),
    }
    got = facts.subject_facts(frames, seen=("PR", "RS"))
    assert got._jdf.queryExecution().analyzed().toString().count("Aggregate") >= 5
    assert {r.USUBJID: (r.in_dm, r.in_vs, r.in_pr, r.in_rs, r.SYSBP, r.VSDTC, r.PR_COUNT) for r in got.collect()} == {
        "S1": (True, True, True, None, 125.0, "2024-01-03", 2), "S2": (None, None, True, None, None, None, 1),
        "S3": (None, None, None, True, None, None, 0), None: (True, True, True, None, None, None, 1)}


@pytest.mark.parametrize("scope", [(), ("STUDYID",)])
@pytest.mark.parametrize("limit", [None, -1])
def test_rules_on_subjects_need_no_scan_of_their_own(spark, table, monkeypatch, scope, limit):
    subjects = ["S1", "S2", " S3", "", None, "Z1", "Z1", "Z2"]
    study = {
        "DM": table("STUDYID USUBJID", [("A", "S1"), ("A", "S2"), ("B", "S3"), (None, "Z2")]),
        "LB": table("STUDYID USUBJID LBTESTCD LBORRES LBDTC", [("AB"[i % 2], s, "ALT", "1", "bad") for i, s in enumerate(subjects)] + [(None, "Z2", "K", "1", "2024-01-01")]),
        "RS": table("STUDYID USUBJID RSTESTCD RSORRES RSDTC", [("A", s, "x", "CR", "2024-01-01") for s in subjects]),
    }

    def found():
        run = pipeline.validate_job(study, scope, outliers=False) if scope else pipeline.validate_all(study, outliers=False)
        return sorted(map(str, run.collect()))
    shipped = found()
    monkeypatch.setattr(pipeline, "broadcast_limit", lambda df: -1)
    if limit is not None:
        monkeypatch.setattr(cross, "broadcast_limit", lambda df: limit)

    def not_scanned(*_):
        raise AssertionError("the subjects are those of the subject table")
    monkeypatch.setattr(cross, "distinct_subjects", not_scanned)
    assert found() == shipped and sum("X_DMLINK_" in r for r in shipped) > 3 and sum("SDTM_LB_004" in r for r in shipped) == 8
