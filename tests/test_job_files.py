"""Files of a job, parsed once, and the documents that the registered job reads."""

import os

from clinisieve.plans import pipeline
from fixtures import documents as docs


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_job_parses_each_file_once(spark, tmp_path, monkeypatch):
    (tmp_path / "dm.json").write_text('[{"USUBJID": "S1", "STUDYID": "A", "SEX": "Q"}]')
    kept, own = {}, pipeline.validate_all
    monkeypatch.setattr(pipeline, "validate_all", lambda frames: kept.update(frames) or own(frames))
    pipeline.run_job(spark, [("DM", "json", str(tmp_path / "dm.json"))], str(tmp_path / "store"), tenant_id="T", job_id="J", study_id="S")
    assert "from_json" not in plan(kept["DM"]) and "parquet" in plan(kept["DM"]).lower()


def test_uploads_are_a_bounded_number_of_documents(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id AS row_index", "CAST(id AS STRING) AS USUBJID")
    monkeypatch.setattr(docs, "AE_PER_DOC", 5)
    monkeypatch.setattr(docs, "DOCS", 3)
    monkeypatch.setattr(docs, "domains", lambda s, d: {"DM": rows})
    (code, kind, path), = docs.uploads(spark, "")
    assert (code, kind) == ("DM", "json") and len([f for f in os.listdir(path) if f.endswith(".txt")]) == 3
    assert sum(t.value.count("USUBJID") for t in spark.read.text(path, wholetext=True).collect()) == 50
