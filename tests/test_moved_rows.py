"""What a validation shuffles."""

import pytest

from clinisieve.operators import cross, facts
from clinisieve.plans import pipeline
from fixtures import tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_domains_share_one_join(spark, tmp_path):
    spark.range(1, 40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 99).selectExpr(
        "id % 45 AS l_orderkey", "id AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity",
        "'A' AS l_returnflag", "TIMESTAMP_NTZ '1995-01-01 00:00:00' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    shared = tables.domains(spark, str(tmp_path), ("vs", "lb", "eg"))
    for code, df in shared.items():
        assert "Join" not in plan(df)
        assert sorted(map(str, df.collect())) == sorted(map(str, tables.view(spark, str(tmp_path), code.lower()).collect()))


@pytest.fixture()
def study(table):
    subjects = ["S1", "S2", " S3", "", None, "Z1", "Z1", "Z2"]
    return {
        "DM": table("STUDYID USUBJID RFSTDTC", [("A", "S1", "2024-01-02"), ("A", "S2", "2024-01-01"), ("B", "S3", None)]),
        "LB": table("STUDYID USUBJID LBTESTCD LBORRES LBDTC", [("AB"[i % 2], s, "ALT", "1", "2024-01-01") for i, s in enumerate(subjects)]),
        "CM": table("STUDYID USUBJID CMTRT CMSTDTC CMENDTC", [("AB"[i % 2], s, "x", "2024-01-05", None) for i, s in enumerate(subjects)]),
        "VS": table("STUDYID USUBJID VSTESTCD VSORRES VSDTC", [("A", s, "SYSBP", "120", "2024-01-03") for s in ("S1", "Z2", "S2")]),
    }


@pytest.mark.parametrize("scope", [(), ("STUDYID",)])
def test_rows_of_known_subjects_are_not_shuffled(spark, study, monkeypatch, scope):
    def found():
        run = pipeline.validate_job(study, scope, outliers=False) if scope else pipeline.validate_all(study, outliers=False)
        return sorted(map(str, run.collect()))
    shipped, asked, own = found(), [], cross.suspect_findings
    monkeypatch.setattr(pipeline, "suspect_findings", lambda df, code, *rest: asked.append(code) or own(df, code, *rest))
    monkeypatch.setattr(pipeline, "broadcast_limit", lambda df: -1)
    assert found() == shipped and any("X_DMLINK_LB_001" in r for r in shipped) and any("X_VSCM_001" in r for r in shipped)
    assert asked == ["CM", "LB"] or asked == ["LB", "CM"]


def test_rows_that_say_nothing_are_not_aggregated(table):
    lb = table("USUBJID LBTESTCD LBORRES", [("S1", "ALT", "1"), ("S1", "K", "9"), ("S2", "K", "2"), ("S3", None, "2")])
    got = facts.subject_facts({"LB": lb}, with_presence=False).collect()
    assert [(r.USUBJID, r.ALT) for r in got] == [("S1", 1.0)]
