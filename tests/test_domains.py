"""Each rule on rows that break it, next to rows that only look as if they did."""

import pytest

from clinisieve.operators.domains import DOMAINS, validate_domain

# domain -> columns, rows, and the expected (rule number, row) pairs
CASES = {
    "DM": ("USUBJID STUDYID SEX AGE AGEU RFSTDTC RFENDTC", [
        ("S1", "ST", " M ", "30", "YEARS", "2024-01-01", "2024-02-01"),
        ("S2", "ST", "X", "121", "YRS", "2024/01/01", "bad"),
        ("", "ST", None, "-1", None, None, None),
        ("S3", "ST", "F", "0", "DAYS", "2024-03-01", "2024-02-01"),
        (" S1 ", "ST", "", "abc", "?", "2024-1-5", "2024-01-05"),
        (None, "ST", "U", "120", " MONTHS", "2024-01", "2024-01-05"),
    ], [("001", 2), ("001", 5), ("002", 0), ("002", 4), ("003", 1), ("003", 4), ("004", 1), ("004", 2), ("005", 1),
        ("005", 2), ("006", 1), ("006", 5), ("007", 1), ("008", 3)]),
    "VS": ("USUBJID VSTESTCD VSORRES VSORRESU VSDTC", [
        ("S1", "SYSBP", "120,5", "mmHg", "2024-01-01"),
        ("nan", " PULSE", "high", "bpm ", "2024-01"),
        ("S1", "BMI", "x", "zz", "2024-01-01"),
        ("S1", "TEMP", None, "K", None),
        ("S1", "RESP", "", None, "2024-01-01"),
        ("S1", None, "1", "kg", "2024-01-01"),
    ], [("001", 1), ("002", 2), ("003", 1), ("004", 1), ("004", 4), ("005", 3)]),
    "AE": ("USUBJID AETERM AESTDTC AEENDTC AESER AESEV", [
        ("S1", "Headache", "2024-01-01", "2024-01-02", "Y", "MILD"),
        ("S1", " ", "UNK", "31/12/1999", "Y ", "GRADE 3"),
        ("S1", None, "2024-02-02", "2024-02-01", None, None),
        (None, "Rash", "2024-02-02", None, "N", " MILD"),
    ], [("001", 1), ("001", 2), ("002", 1), ("003", 1), ("004", 2), ("005", 1), ("006", 1), ("006", 3)]),
    "CM": ("USUBJID CMTRT CMSTDTC CMENDTC", [
        ("S1", "ASPIRIN", "2024-01-01", "2024-01-01"), ("S1", "", "bad", "bad"),
        ("S1", "X", "2024-03-01", "2024-02-01"),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 2)]),
    "EX": ("USUBJID EXTRT EXDOSE EXDOSU EXROUTE EXSTDTC EXENDTC", [
        ("S1", "DRUG", "100", "mg", " ORAL", "2024-01-01", "2024-01-02"),
        ("", " ", "high", "MG", "NASAL", "bad", "bad"),
        ("S1", "DRUG", "-5", None, None, "2024-03-01", "2024-02-01"),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 2), ("005", 1), ("006", 1), ("007", 2), ("008", 1), ("009", 1)]),
    "LB": ("USUBJID LBTESTCD LBORRES LBSTRESN LBNRIND LBDTC", [
        ("S1", "ALT", "20", "20", "NORMAL", "2024-01-01"), (None, "GLUCOSE", "", "1d", "ELEVATED", "05/05/2024"),
        ("S1", "NA", "140", None, " HIGH ", None),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 1), ("005", 1), ("006", 1)]),
    "DS": ("USUBJID DSDECOD DSTERM DSCAT DSSTDTC", [
        ("S1", "COMPLETED", "Completed", "DISPOSITION EVENT", "2024-01-01"),
        (" ", "", "nan", "ENROLLMENT", "2000-13-01"), ("S1", None, "x", None, None),
    ], [("001", 1), ("002", 1), ("002", 2), ("003", 1), ("004", 1), ("005", 1), ("006", 1)]),
    "EG": ("USUBJID EGTESTCD EGORRES EGORRESU EGDTC", [
        ("S1", "QTCF", "410", "msec", "2024-01-01"), ("", "PACE", "x", "sec", "05-23-2024"),
        ("S1", "QT", "ABNORMAL", "sec", None),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 2), ("005", 2)]),
    "QS": ("USUBJID QSCAT QSTESTCD QSORRES QSSTRESN QSSTAT QSREASND QSDTC", [
        ("S1", "PAIN", "Q1", "3", "3", None, None, "2024-01-01"),
        (None, "", " ", None, "n/v", "DONE", None, "04/25/2024"),
        ("S1", "PAIN", "Q1", None, None, "NOT DONE", "", None),
        ("S1", "PAIN", "Q1", "", None, " NOT DONE ", "refused", None),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 1), ("005", 1), ("006", 1), ("007", 1), ("008", 2)]),
    "RS": ("USUBJID RSTESTCD RSORRES RSEVAL RSSTAT RSREASND RSDTC", [
        ("S1", "OVRLRESP", "CR", "INVESTIGATOR", None, None, "2024-01-01"),
        ("", "", "MIXED", "SITE RADIOLOGIST", "DONE", None, "15/13/2024"),
        ("S1", "OVRLRESP", None, None, "NOT DONE", None, None),
        ("S1", "OVRLRESP", None, None, None, None, None),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 1), ("005", 1), ("006", 1), ("007", 3), ("008", 2)]),
    "PR": ("USUBJID PRTRT PRCAT PRSTDTC PRENDTC", [
        ("S1", "BIOPSY", "DIAGNOSTIC", "2024-01-01", "2024-01-01"),
        ("", "", "REHABILITATION", "not-a-date", "bad"), ("S1", "X", None, "2024-04-01", "2024-03-30"),
    ], [("001", 1), ("002", 1), ("003", 1), ("004", 1), ("005", 2), ("006", 1)]),
}


@pytest.mark.parametrize("code", CASES)
def test_rules(code, table, hits):
    columns, rows, expected = CASES[code]
    assert hits(validate_domain(table(columns, rows), code)) == sorted(
        (f"SDTM_{code}_{n}", row) for n, row in expected)


@pytest.mark.parametrize("code", DOMAINS)
def test_a_missing_required_column_is_the_only_finding(code, table):
    missing = DOMAINS[code].required[-1]
    columns = [c for c in DOMAINS[code].required if c != missing]
    found = validate_domain(table(" ".join(columns), [("",) * len(columns)] * 3), code).collect()
    assert [(r.rule_id, r.severity, r.field, r.row_index, r.message) for r in found] == [
        (f"SDTM_{code}_000", "CRIT", missing, -1, f"Missing required columns for {code}: ['{missing}']")]


def test_messages_and_evidence(table):
    ex = validate_domain(table("USUBJID EXTRT EXSTDTC EXENDTC EXDOSU",
                               [("S1", "D", "2024-04-01", "2024-03-30", "MG")]), "EX").collect()
    got = {r.rule_id: r for r in ex}
    assert got["SDTM_EX_009"].message == "EXDOSU should be one of: ['mg', 'g', 'mcg', 'mL', 'IU']. (found: 'MG')"
    assert got["SDTM_EX_007"].evidence == "2024-04-01 > 2024-03-30"
    assert got["SDTM_EX_007"].field == "EXSTDTC/EXENDTC"
    vs = validate_domain(table("USUBJID VSTESTCD VSORRES VSORRESU VSDTC",
                               [("S1", "WEIGHT", "70", "stone", "2024-01-01")]), "VS").collect()
    assert [(r.evidence, r.message) for r in vs] == [
        ("WEIGHT / stone", "VSORRESU unit is not consistent with VSTESTCD. (found: 'WEIGHT / stone')")]


def test_optional_columns_may_be_absent(table, hits):
    eg = validate_domain(table("USUBJID EGTESTCD EGORRES EGDTC", [("S1", "QT", "400", "2024-01-01")] * 2), "EG")
    assert [(r.rule_id, r.severity, r.row_index) for r in eg.collect()] == [("SDTM_EG_005", "LOW", -1)]
    qs = table("USUBJID QSCAT QSTESTCD QSORRES QSDTC", [("S1", "P", "Q", None, None), ("S1", "P", "Q", "1", None)])
    assert hits(validate_domain(qs, "QS")) == [("SDTM_QS_007", 0)]
    rs = table("USUBJID RSTESTCD RSORRES RSDTC RSSTAT", [("S1", "O", None, None, "NOT DONE")])
    found = validate_domain(rs, "RS").collect()
    assert [(r.rule_id, r.evidence) for r in found] == [("SDTM_RS_008", "NOT DONE")]


def test_empty_tables_give_nothing(table, hits):
    assert hits(validate_domain(table("STUDYID", []), "DM")) == []
    assert hits(validate_domain(table("USUBJID STUDYID SEX", []), "DM")) == []


def test_typed_columns_are_read_as_texts(spark):
    from datetime import date, datetime
    from decimal import Decimal

    from clinisieve.functions.text import as_texts
    row = (1, 2, 3.5, 4.0, float("nan"), Decimal("1.50"), True, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4), "x", 1e20, None)
    df = spark.createDataFrame([row], "row_index bigint, a int, b double, c float, d double, e decimal(5,2), f boolean, g date, h timestamp, i string, j double, k int")
    assert tuple(as_texts(df, "row_index").first()) == (1, "2", "3.5", "4.0", None, "1.50", "true", "2024-01-02", "2024-01-02", "x", "1e+20", None)
    dm = spark.createDataFrame([(0, "S1", "X", 150, date(2024, 2, 1), date(2024, 1, 1), 5)],
                               "row_index bigint, USUBJID string, SEX string, AGE int, RFSTDTC date, RFENDTC date, STUDYID int")
    found = {(r.rule_id, r.evidence) for r in validate_domain(dm, "DM").collect()}
    texts = dm.selectExpr("row_index", "USUBJID", "SEX", "CAST(AGE AS STRING) AGE", "CAST(RFSTDTC AS STRING) RFSTDTC", "CAST(RFENDTC AS STRING) RFENDTC", "CAST(STUDYID AS STRING) STUDYID")
    assert found == {(r.rule_id, r.evidence) for r in validate_domain(texts, "DM").collect()} and any(e == "2024-02-01 > 2024-01-01" for _, e in found)
