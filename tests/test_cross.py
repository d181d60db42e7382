from clinisieve.operators import cross
from clinisieve.plans import pipeline

DM = ("USUBJID STUDYID RFSTDTC RFENDTC", [
    ("S1", "A", "2024-01-10", "2024-06-01"), (" S2 ", "A", "2024-01-10", "2024-06-01"), ("S3", "A", None, None),
    ("", "A", None, None), ("S1", "A", "2024-01-10", "2024-06-01")])
VS = ("USUBJID VSTESTCD VSORRES VSDTC", [
    ("S1", "SYSBP", "120", "2024-02-01"), ("S1", "SYSBP", "120", "2024-03-01"), ("S2", "SYSBP", "120", "bad"),
    ("S2", "SYSBP", "130", "2024-05-01"), ("", "SYSBP", "1", "2024-02-01")])
AE = ("USUBJID AETERM AESTDTC", [
    ("S1", "a", "2024-02-15"), ("S1", "a", "2024-01-31"), ("S9", "a", "2024-02-01"), ("", "a", "2024-12-01"),
    ("S3", "a", "2024-02-01"), ("S1", "a", "2024-03-02"), ("S1", "a", "UNK")])
CM = ("USUBJID CMTRT CMSTDTC CMENDTC", [
    ("S1", "x", "2024-02-10", "2024-02-20"), ("S1", "x", "2024-02-15", None), ("S2", "x", None, "2024-01-01"),
    ("S8", "x", "2024-01-01", "2024-01-02")])
EX = ("USUBJID EXTRT EXSTDTC EXENDTC", [
    ("S1", "d", "2024-01-01", "2024-02-01"), ("S2", "d", "2024-01-10", "2024-06-02"), ("S2", "d", "2024-07-01", None),
    ("S1", "d", None, "2025-01-01"), ("S9", "d", "2024-01-01", None)])
DS = ("USUBJID DSDECOD DSTERM DSCAT DSSTDTC", [
    ("S1", "COMPLETED", "c", "PROTOCOL MILESTONE", "2023-01-01"), ("S1", "COMPLETED", "c", "DISPOSITION EVENT", "2024-05-01"),
    ("S2", "COMPLETED", "c", " DISPOSITION EVENT ", "2024-06-15"), ("S2", "COMPLETED", "c", None, "2024-01-01")])

LINKS = [("X_DMLINK_AE_001", 2), ("X_DMLINK_CM_001", 3), ("X_DMLINK_EX_001", 4)]
WINDOWS = [
    ("X_VSAE_001", 2), ("X_VSAE_001", 4), ("X_VSAE_002", 1), ("X_VSAE_002", 3), ("X_VSAE_002", 5),
    ("X_VSCM_001", 3), ("X_VSCM_002", 0), ("X_VSCM_002", 1),
    # S1 is in demographics twice, so its doses count twice
    ("X_IRT_001", 0), ("X_IRT_001", 0), ("X_IRT_002", 1), ("X_IRT_002", 2), ("X_IRT_003", 2)]


def test_each_check(table, hits):
    dm, vs, ae, cm, ex, ds = (table(*t) for t in (DM, VS, AE, CM, EX, DS))
    found = [*hits(cross.dm_link(dm, ae, "AE")), *hits(cross.dm_link(dm, cm, "CM")), *hits(cross.dm_link(dm, ex, "EX"))]
    assert found == LINKS
    found = [*hits(cross.vs_ae(vs, ae)), *hits(cross.vs_cm(vs, cm)), *hits(cross.irt(dm, ex, ds))]
    assert sorted(found) == sorted(WINDOWS)


def frames(table):
    return {code: table(*t) for code, t in
            {"DM": DM, "VS": VS, "AE": AE, "CM": CM, "EX": EX, "DS": DS}.items()}


def cross_hits(findings, hits):
    return hits(findings.filter("finding_type = 'CROSS_DOMAIN'"))


def test_all_checks_in_one_pass(table, hits, monkeypatch):
    found = pipeline.validate_all(frames(table), outliers=False)
    assert cross_hits(found, hits) == sorted(LINKS + WINDOWS)
    assert {r.domain for r in found.filter("finding_type = 'CROSS_DOMAIN'").collect()} == {"CROSS"}


def test_all_checks_when_nothing_can_be_shipped(spark, table, hits):
    """Without broadcasts every join is shuffled; the findings stay the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pipeline.validate_all(frames(table), outliers=False)
        assert cross_hits(found, hits) == sorted(LINKS + WINDOWS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence(table):
    dm, vs, ae, cm, ex, ds = (table(*t) for t in (DM, VS, AE, CM, EX, DS))
    ev = {(r.rule_id, r.row_index): r.evidence for f in (cross.vs_ae(vs, ae), cross.vs_cm(vs, cm), cross.irt(dm, ex, ds))
          for r in f.collect()}
    assert ev["X_VSAE_002", 1] == "2024-01-31 vs [2024-02-01, 2024-03-01]"
    assert ev["X_VSCM_002", 0] == "2024-02-01 vs [2024-02-10, 2024-02-20]"
    assert ev["X_IRT_001", 0] == "EXSTDTC=2024-01-01 < RFSTDTC=2024-01-10"
    assert ev["X_IRT_002", 2] == "last dose=2024-07-01 > RFENDTC=2024-06-01"
    assert ev["X_IRT_003", 2] == "last dose=2024-07-01 > DSSTDTC=2024-06-15"


def test_without_disposition_events_any_row_counts(table, hits):
    ds = table("USUBJID DSDECOD DSCAT DSSTDTC", [("S1", "C", "PROTOCOL MILESTONE", "2023-01-01")])
    assert [h for h in hits(cross.irt(table(*DM), table(*EX), ds)) if h[0] == "X_IRT_003"] == [("X_IRT_003", 0)]


def test_nothing_is_an_orphan_of_an_empty_table(table, hits):
    assert hits(cross.vs_ae(table(VS[0], []), table(*AE))) == []
    assert cross_hits(pipeline.validate_all({"VS": table(VS[0], []), "AE": table(*AE)}), hits) == []


def test_missing_columns(table):
    no_key = table("STUDYID", [("A",)])
    found = [cross.dm_link(no_key, table(*AE), "AE"), cross.vs_ae(table("USUBJID", [("S1",)]), table(*AE)),
             cross.vs_cm(table(*VS), table("USUBJID", [("S1",)])), cross.irt(table("USUBJID", [("S1",)]), table(*EX), None)]
    assert [(r.rule_id, r.severity, r.field, r.row_index) for f in found for r in f.collect()] == [
        ("X_DMLINK_AE_000", "CRIT", "USUBJID", -1), ("X_VSAE_000", "CRIT", "USUBJID/--DTC", -1),
        ("X_VSCM_000", "CRIT", "USUBJID/--DTC", -1), ("X_IRT_000", "CRIT", "USUBJID", -1)]


def test_many_studies_at_once_equal_each_study_alone(table):
    from pyspark.sql import functions as F

    def strip(found, study):
        cols = ["rule_id", "severity", "domain", "field", "message", "row_index", "usubjid", "evidence"]
        return sorted(tuple(r) for r in found.filter(F.col("STUDYID") == study).select(*cols).collect())

    one = frames(table)
    # The second study has no vital signs and no disposition events.
    two = {c: df for c, df in one.items() if c != "VS"}
    two["DS"] = two["DS"].filter("DSCAT = 'PROTOCOL MILESTONE'")
    tagged = {}
    for code in one:
        parts = [f[code].withColumn("STUDYID", F.lit(s)) for s, f in (("A", one), ("B", two)) if code in f]
        tagged[code] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    together = pipeline.validate_job(tagged, ("STUDYID",))
    for study, alone in (("A", one), ("B", two)):
        expected = pipeline.validate_all(alone, outliers=False).withColumn("STUDYID", F.lit(study))
        assert strip(together, study) == strip(expected, study)
