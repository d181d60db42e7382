import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinisieve.findings import COLUMNS, empty_findings, union_findings
from clinisieve.operators.domains import validate_domain
from clinisieve.plans import pipeline
from clinisieve.sources import dataset_json as dj
from clinisieve.sources import csv_records, files, form_export, large_documents, logs, rowid, sinks
from clinisieve.sources.scratch import written


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_nulls_spaces_and_positions(spark, tmp_path):
    write(tmp_path / "b.csv", "USUBJID,SEX\nS3,NA\n\"S,4\",\"he said \"\"x\"\"\"\n")
    write(tmp_path / "a.csv", "USUBJID,SEX\nS1, NA \n,M\n")
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path)).orderBy("row_index").collect()]
    assert got == [("S1", " NA ", 0), (None, "M", 1), ("S3", None, 2), ("S,4", 'he said "x"', 3)]


def test_positions_hold_over_split_files(spark, tmp_path):
    for name, start, n in (("one", 0, 5000), ("two", 5000, 30), ("three", 5030, 2000)):
        order = {"one": "a", "two": "b", "three": "c"}[name]
        write(tmp_path / f"{order}.csv", "N,T\n" + "".join(f"{i},{'x' * 20}\n" for i in range(start, start + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 4
        df = files.read_csv(spark, str(tmp_path))
        assert df.filter("CAST(N AS BIGINT) <> row_index").count() == 0 and df.count() == 7030
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


FIELDS = ["plain", '"a\nb"', '"a ""q"" b"', '"x\n\n\ny"', '5" x', '""', '"ends""\n"', '"\r\nin"', '" ,\n,"', 'a"b',
          '"' + "\n".join(f"line {k}, z" for k in range(90)) + '"', '"""\n"""', '"\n"']


@pytest.mark.parametrize("seed", range(4))
def test_line_breaks_in_quotes_at_the_borders_of_pieces(spark, tmp_path, seed):
    rnd, want = random.Random(seed), []
    for f in range(2):
        out = "ID,TEXT,N\n" if f or seed < 2 else '"ID",TEXT,N\r\n'
        for i in range(60):
            out += f"{f * 100 + i},{rnd.choice(FIELDS)},{i}" + rnd.choice(["\n", "\n", "\r\n"] if seed else ["\n"]) + rnd.choice(["", "", "\n", "  \n"])
        (tmp_path / f"f{f}.csv").write_bytes(out.encode())
        frame = pd.read_csv(tmp_path / f"f{f}.csv", dtype=str, keep_default_na=False)
        want += [tuple(x or None for x in r) for r in frame.itertuples(index=False)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pieces = csv_records.pieces_of(csv_records.lines_of(spark, str(tmp_path)))
        assert pieces.count() > 8 and pieces.where("entry").count() > 1
        got = files.read_csv(spark, str(tmp_path)).orderBy("row_index").collect()
        assert [(r.ID, r.TEXT, r.N) for r in got] == want
        assert [r.row_index for r in got] == list(range(len(want)))
        assert [r.row_count for r in files.csv_row_counts(spark, str(tmp_path)).collect()] == [60, 60]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_without_rows_and_open_ends(spark, tmp_path):
    write(tmp_path / "a.csv", 'A,"B\nC"\n')
    assert files.read_csv(spark, str(tmp_path)).columns == ["A", "B\nC", "row_index"] and files.read_csv(spark, str(tmp_path)).count() == 0
    write(tmp_path / "a.csv", 'A,B\n1,2\n3,"never\nshut\n')
    assert [(r.A, r.row_index) for r in files.read_csv(spark, str(tmp_path)).orderBy("row_index").collect()] == [("1", 0), ("3", 1)]
    write(tmp_path / "b.csv", 'A,C\n1,"x\ny"\n')
    with pytest.raises(ValueError, match="different headers"):
        files.read_csv(spark, str(tmp_path))
    assert csv_records.header_names('x,"",X,y') == ["x0", "_c1", "X2", "y"]


def test_a_break_in_a_study_file_is_no_row(spark, tmp_path, hits):
    write(tmp_path / "dm.csv", "STUDYID,USUBJID,SEX,RFSTDTC\nA,S1,M,2024-01-01\n")
    write(tmp_path / "ae.csv", 'USUBJID,AETERM,AESTDTC\nS1,"Rash\non the arm",2024-01-01\nS1,Cough,2024-01-02\n')
    frames = files.read_study(spark, str(tmp_path))
    assert frames["AE"].count() == 2
    assert not [h for h in hits(pipeline.validate_all(frames, outliers=False)) if h[0] in ("SDTM_AE_002", "X_DMLINK_AE_001")]


def test_parquet_positions(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    df = rowid.with_parquet_row_index(spark.read.parquet(path))
    assert df.filter("id <> row_index").count() == 0 and df.count() == 1000


def test_study_folder(spark, tmp_path, hits):
    write(tmp_path / "dm.csv", "STUDYID,USUBJID,SEX\nA,S1,M\nA,S2,X\n")
    write(tmp_path / "ae.csv", "USUBJID,AETERM,AESTDTC\nS1,,2024-01-01\nS9,Rash,2024-13-01\n")
    frames = files.read_study(spark, str(tmp_path))
    assert set(frames) == {"DM", "AE"}
    found = pipeline.validate_all(frames, outliers=False)
    assert [h for h in hits(found) if not h[0].startswith("GENERIC")] == [
        ("SDTM_AE_001", 0), ("SDTM_AE_002", 1), ("SDTM_DM_003", 1), ("X_DMLINK_AE_001", 1)]


def test_flat_file_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing required columns"):
        files.read_generic(spark, write(tmp_path / "g.csv", "AGE,SYSBP\n1,2\n"))


def test_json_records(spark, tmp_path):
    rows = [{"USUBJID": "S1", "AGE": 30}, {"USUBJID": "S2"}]
    for text in (json.dumps(rows), json.dumps({"records": rows, "n": 2})):
        df = files.read_json_records(spark, write(tmp_path / "r.json", text))
        assert sorted((r.row_index, r.USUBJID, r.AGE) for r in df.collect()) == [(0, "S1", "30"), (1, "S2", None)]


def test_json_documents_of_several_layouts(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    texts = {"a": [{"USUBJID": "S1", "AGE": 30}, {"USUBJID": "S2"}], "b": {"records": [{"USUBJID": "S3", "SEX": "M"}]}, "c": {"records": []}, "d": {"note": "none"}}
    for name, value in texts.items():
        write(tmp_path / "docs" / f"{name}.json", json.dumps(value))
    df = files.read_json_records(spark, str(tmp_path / "docs"))
    assert sorted((r.USUBJID, r.AGE, r.SEX, r.row_index) for r in df.collect()) == [("S1", "30", None, 0), ("S2", None, None, 1), ("S3", None, "M", 0)]


def test_a_job_reads_validates_stores_and_counts(spark, tmp_path):
    dm = {"clinicalData": {"itemGroupData": {"IG.DM": {
        "name": "DM", "items": items("USUBJID", "STUDYID", "SEX"), "itemData": [["S1", "A", "X"], ["S2", "A"]]}}}}
    datasets = [
        ("DM", "Dataset-JSON", write(tmp_path / "dm.json", json.dumps(dm))),
        ("AE", "csv", write(tmp_path / "ae.csv", "USUBJID,AETERM,AESTDTC\nS9,a,2024-01-01\n")),
        ("CM", "json", write(tmp_path / "cm.json", json.dumps([{"USUBJID": "S1", "CMTRT": "", "CMSTDTC": "bad"}]))),
        ("VS", "dataset-json", write(tmp_path / "vs.json", "[]")), ("LB", "xpt", str(tmp_path / "lb.xpt"))]
    store = str(tmp_path / "store")
    counts = pipeline.run_job(spark, datasets, store, tenant_id="T", job_id="J", study_id="S")
    stored = spark.read.parquet(store)
    assert sorted(r.rule_id for r in stored.collect() if not r.rule_id.startswith("GENERIC")) == [
        "DJ_001", "DJ_106", "SDTM_CM_001", "SDTM_CM_002", "SDTM_DM_003", "X_DMLINK_AE_001"]
    assert counts["total"] == stored.count() and counts["CRIT"] == 1


def test_formats(spark):
    df = spark.createDataFrame([("A.CSV", None), ("x.json", None), ("x", None), ("a.csv", "Dataset-JSON"), ("a", "xpt")],
                               "f string, g string")
    got = [(r.format, r.allowed) for r in files.with_format(df, "f", "g").collect()]
    assert got == [("csv", True), ("json", True), ("json", True), ("dataset-json", True), ("xpt", False)]


def test_log_lines(spark, tmp_path):
    path = write(tmp_path / "x.log", "2025-01-01 10:00:00 [INFO] Test info message\n2025-01-01 10:01:00 [ERROR] boom  \n"
                 "Traceback\n2025-01-01 10:02:00 [WARNING] hm\n2025-99-01 10:02:00 [INFO] no such day\n")
    entries = logs.read_log(spark, path)
    assert [(str(r.timestamp), r.level, r.message) for r in entries.collect()] == [
        ("2025-01-01 10:00:00", "INFO", "Test info message"), ("2025-01-01 10:01:00", "ERROR", "boom"),
        ("2025-01-01 10:02:00", "WARNING", "hm")]
    assert logs.by_level(entries, "error").count() == 1


def test_findings_sinks(spark, table, tmp_path):
    found = validate_domain(table("USUBJID STUDYID SEX", [("S1", "A", " X "), ("", "A", "M")]), "DM")
    path = sinks.write_csv(found, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == COLUMNS and back.count() == 2
    sinks.store_findings(found, str(tmp_path / "store"), "T", "J", "ST")
    sinks.store_findings(found, str(tmp_path / "store"), "T", "J2", "ST")
    stored = spark.read.parquet(str(tmp_path / "store")).filter("tenant_id = 'T' AND study_id = 'ST'")
    assert stored.count() == 4
    assert {(r.usubjid, r.evidence, r.status) for r in stored.collect()} == {("S1", "X", "open"), (None, None, "open")}
    sinks.write_documents(found, str(tmp_path / "docs"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "docs")).collect()]
    assert {d["rule_id"] for d in lines} == {"SDTM_DM_001", "SDTM_DM_003"} and set(lines[0]) == set(COLUMNS)


def test_empty_findings(spark, table):
    none = empty_findings(spark)
    assert none.columns == COLUMNS and none.count() == 0
    some = validate_domain(table("USUBJID STUDYID", [("", "A")]), "DM")
    assert union_findings([none, some, some]).count() == 2


# --- Dataset-JSON -----------------------------------------------------------------------------------

def docs_of(spark, *texts):
    return spark.createDataFrame([(str(i), t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)],
                                 "doc_id string, text string")


def items(*names):
    return [{"OID": f"IT.{n}", "name": n} for n in names]


def test_top_level(spark):
    docs = docs_of(spark, {"clinicalData": {"itemGroupData": {}}}, {"referenceData": {"itemGroupData": {}}}, [], {"foo": {}},
                   {"clinicalData": []}, {"clinicalData": {}}, {"clinicalData": {"itemGroupData": []}},
                   {"clinicalData": None}, "not json", '"text"')
    got = {r.doc_id: (r.rule_id, r.severity, r.field) for r in dj.top_level_findings(docs).collect()}
    assert got == {"2": ("DJ_001", "CRIT", "root"), "3": ("DJ_002", "CRIT", "clinicalData/referenceData"),
                   "4": ("DJ_002b", "CRIT", "clinicalData"), "5": ("DJ_003", "CRIT", "itemGroupData"),
                   "6": ("DJ_004", "CRIT", "itemGroupData"), "7": ("DJ_002b", "CRIT", "clinicalData"),
                   "8": ("DJ_001", "CRIT", "root"), "9": ("DJ_001", "CRIT", "root")}
    assert sorted(r.doc_id for r in dj.stop_gate(docs).collect()) == ["0", "1"]


def test_groups_are_found_by_name_then_by_key(spark):
    groups = {"IG.ADAE": {"items": items("A")}, "X": {"name": "ae"}, "Z.DM.1": {}, "IG.CM": 5, "Q": {"name": "zz"}}
    docs = docs_of(spark, {"clinicalData": {"itemGroupData": groups}})
    assert [r.oid for r in dj.item_groups(docs).orderBy("position").collect()] == list(groups)
    assert {r.domain: r.oid for r in dj.infer_oids(docs).collect()} == {"AE": "X", "DM": "Z.DM.1", "CM": "IG.CM", "VS": None}
    del groups["X"]
    docs = docs_of(spark, {"clinicalData": {"itemGroupData": groups}})
    assert {r.domain: r.oid for r in dj.infer_oids(docs, ("AE",)).collect()} == {"AE": "IG.ADAE"}


def test_group_and_record_faults(spark):
    groups = {"DM": {"items": []}, "VS": {"items": items("A"), "itemData": 3}, "AE": {"items": ["x", 2]}, "CM": "text"}
    found = {r.rule_id: r for r in dj.group_findings(docs_of(spark, {"clinicalData": {"itemGroupData": groups}})).collect()}
    assert {k: (r.field, r.message) for k, r in found.items()} == {
        "DJ_101": ("DM.items", "Non-empty 'items' array required."),
        "DJ_102": ("VS.itemData", "'itemData' must be an array."),
        "DJ_104": ("AE.items", "Could not derive column names."),
        "DJ_100": ("itemGroupData", "OID 'CM' not found.")}
    nothing = dj.group_findings(docs_of(spark, {"clinicalData": {"itemGroupData": {"Q": {}, "R": {}}}}), ("DM",)).first()
    assert (nothing.rule_id, nothing.message, nothing.evidence) == (
        "DJ_110", "Could not infer OID for domain 'DM'.", "Q; R")
    group = {"items": [{"name": "A"}, "skip", {"name": "", "OID": "B"}, {}],
             "itemData": [["1", 2, None], "bad", ["x"], [True, 1.5, "c", "extra"]]}
    docs = docs_of(spark, {"referenceData": {"itemGroupData": {"DM": group}}})
    assert [(r.rule_id, r.field, r.row_index, r.evidence) for r in
            dj.record_findings(docs, ("DM",)).orderBy("row_index").collect()] == [
        ("DJ_105", "DM.itemData[1]", 1, ""), ("DJ_106", "DM.itemData[2]", 2, "got 1, expected 3"),
        ("DJ_106", "DM.itemData[3]", 3, "got 4, expected 3")]
    rows = dj.rows(docs, ("DM",)).orderBy("row_index").collect()
    assert rows[0]["_columns"] == ["A", "B", "COL_3"]
    assert [(r.row_index, r["values"]) for r in rows] == [
        (0, ["1", "2", None]), (1, ["x", None, None]), (2, ["true", "1.5", "c"])]


def test_documents_are_validated_one_by_one(spark):
    dm = {"name": "DM", "items": items("USUBJID", "STUDYID", "SEX"),
          "itemData": [["S1", "A", "M"], ["S1", "A", "X"], ["S2", "A", None]]}
    ae = {"items": items("USUBJID", "AETERM", "AESTDTC"), "itemData": [["S1", "a", "2024-01-01"], ["S3", "", "bad"]]}
    vs = {"items": items("USUBJID", "VSTESTCD", "VSORRES", "VSDTC"), "itemData": [["S2", "SYSBP", "1", "2024-01-01"]]}
    cm = {"items": items("CMTRT"), "itemData": [["x"]]}
    docs = docs_of(spark, {"clinicalData": {"itemGroupData": {"IG.DM": dm, "IG.AE": ae, "IG.VS": vs, "IG.CM": cm}}},
                   {"clinicalData": {"itemGroupData": {"IG.AE": ae}}})
    got = sorted((r.doc_id, r.rule_id, r.row_index) for r in dj.validate_documents(docs).collect())
    assert got == sorted([
        ("0", "SDTM_DM_002", 0), ("0", "SDTM_DM_002", 1), ("0", "SDTM_DM_003", 1), ("0", "SDTM_AE_001", 1),
        ("0", "SDTM_AE_002", 1), ("0", "X_DMLINK_AE_001", 1), ("0", "SDTM_VS_005", -1), ("0", "SDTM_CM_000", -1),
        ("0", "X_DMLINK_CM_000", -1),
        # The second document has no demographics, so nothing in it is an orphan.
        ("1", "DJ_110", -1), ("1", "DJ_110", -1), ("1", "DJ_110", -1), ("1", "SDTM_AE_001", 1), ("1", "SDTM_AE_002", 1)])


def test_envelopes(spark):
    envelope = {"datasetJSONVersion": "1.0", "itemGroupOID": "IG.DM", "records": 1,
                "columns": [{"itemOID": "IT.DM.USUBJID", "name": "USUBJID"}, {"name": "STUDYID"}], "rows": [["S1", "A"]]}
    docs = docs_of(spark, envelope, {"clinicalData": {"itemGroupData": {}}})
    assert [r.rule_id for r in dj.top_level_findings(docs).collect()] == ["DJ_002"]
    opened = dj.unwrap_envelopes(docs)
    assert dj.top_level_findings(opened).count() == 0
    assert [r["values"] for r in dj.rows(opened, ("DM",)).collect()] == [["S1", "A"]]


def test_document_files(spark, tmp_path):
    write(tmp_path / "one.json", json.dumps({"clinicalData": {"itemGroupData": {"A": {}}}}, indent=2))
    write(tmp_path / "two.json", "[]")
    found = dj.top_level_findings(dj.read_documents(spark, str(tmp_path))).collect()
    assert [(os.path.basename(r.doc_id), r.rule_id) for r in found] == [("two.json", "DJ_001")]


# --- form exports -----------------------------------------------------------------------------------

def test_form_export(spark):
    metadata = spark.createDataFrame([
        (0, "record_id", "demographics", "text", "ID"), (1, "age", "Demographics", "calc", None),
        (2, "note", "visit", "notes", "Note"), (3, "pain", "visit", "slider", "Pain"), (4, "x", None, None, "")],
        "position int, field_name string, form_name string, field_type string, field_label string")
    records = spark.createDataFrame([("1", '{"record_id":"1","age":30,"note":"n"}'), ("2", '{"record_id":"2","pain":7}')],
                                    "record_id string, record string")
    fields = form_export.form_fields(metadata, "DEMOGRAPHICS").orderBy("position").collect()
    assert [(f.itemOID, f.name, f.dataType, f.label, f.length) for f in fields] == [
        ("IT.DEMOGRAPHICS.RECORD_ID", "RECORD_ID", "string", "ID", 200), ("IT.DEMOGRAPHICS.AGE", "AGE", "float", "", 20)]
    rows = {r.record_id: (r["columns"], r["values"]) for r in form_export.flatten(metadata, records, "demographics").collect()}
    assert rows == {"1": (["RECORD_ID", "AGE"], ["1", "30"]), "2": (["RECORD_ID", "AGE"], ["2", ""])}
    assert form_export.form_fields(metadata, "unknown").count() == 5
    assert [r.form for r in form_export.forms(metadata).collect()] == ["DEMOGRAPHICS", "UNKNOWN", "VISIT"]
    assert [r.usubjid for r in form_export.subjects(records).collect()] == ["1", "2"]


def test_projects(spark):
    listing = spark.createDataFrame([
        ('{"project_id":7,"project_title":"T","is_longitudinal":0,"purpose":"p","purpose_other":"o","project_pi_firstname":"A",'
         '"project_pi_lastname":"B"}',), ('{"project_id":8}',)], "project string")
    assert [tuple(r) for r in form_export.projects(listing).collect()] == [
        ("7", "T", "active", "o", ""), ("8", "", "unknown", "", "")]
    assert tuple(form_export.project_metadata(listing, "7").first()) == ("7", "T", "A B", "", "", "active")


# --- large documents ------------------------------------------------------------------------------------

TRICKY = {"itemData": [[1]], "clinicalData": {"x": [["itemData", [1, 2]]], "itemGroupData": {
    "IG.DM": {"name": "DM", "items": items("USUBJID", "STUDYID", "SEX"), "itemData": [
        [f"S{i}", 'a "quoted" ] , [ \\\\ text', {"itemData": [[1], [2]]} if i % 9 == 0 else "M"] if i % 7 else (f"no, array [{i}" if i % 2 else {"a": [1, 2]})
        for i in range(60)]},
    "IG.AE": {"items": items("USUBJID", "AETERM", "AESTDTC"), "itemData": []},
    "VS": {"items": items("USUBJID"), "itemData": "none"}, "CM": {"items": [{"itemData": [3]}], "itemData": [["x"], ["y", "z"]]}}}}


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_taken_apart_give_the_same(spark, monkeypatch, indent):
    texts = [json.dumps(TRICKY, indent=indent), json.dumps(TRICKY["clinicalData"]), '{"referenceData":{"itemGroupData":{"DM":{"itemData":5,"itemData":[[1],[2]],"items":[{"name":"A"}]}}}}',
             "{}", "[]", '{"clinicalData":{"itemGroupData":{"DM":{"items":[{"name":"A"}],"itemData":[[1],[2,}]}}}}', '{"clinicalData":{"itemGroupData":{"DM":{"itemData":[[1],']
    docs = written(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"))
    want = dj.opened_groups(docs)

    def results(docs, opened):
        return [sorted(map(str, f.collect())) for f in (
            dj.top_level_findings(docs), dj.group_findings(docs, opened=opened), dj.record_findings(docs, opened=opened), dj.rows(docs, opened=opened))]

    small, chunks = large_documents.split_large(docs, 10, 90)
    assert chunks.groupBy("doc_id", "mark").count().agg({"count": "max"}).first()[0] > 5
    assert results(small, dj.opened_groups(small, chunks=chunks)) == results(docs, want)
    assert [len(x) for x in results(docs, want)][0] == 5
    monkeypatch.setattr(large_documents, "LARGE_BYTES", 10)
    monkeypatch.setattr(large_documents, "CHUNK", 90)
    apart = sorted(map(str, dj.validate_documents(docs).collect()))
    monkeypatch.undo()
    assert apart == sorted(map(str, dj.validate_documents(docs).collect()))


def test_a_document_beyond_one_variant_value(spark, tmp_path):
    """More bytes than a variant may have: every record is read, by several tasks."""
    record = json.dumps(["S1", "A", "x" * 900])
    head = '{"clinicalData":{"itemGroupData":{"IG.DM":{"name":"DM","items":' + json.dumps(items("USUBJID", "STUDYID", "SEX")) + ',"itemData":['
    n = 150_000
    (tmp_path / "big.json").write_text(head + ",".join([record] * n) + "]}}}}")
    raw = dj.read_documents(spark, str(tmp_path))
    assert raw.select(F.expr("try_parse_json(text) IS NULL")).first()[0]
    docs, chunks = large_documents.split_large(raw)
    assert dj.top_level_findings(docs).count() == 0
    rows = dj.rows(docs, ("DM",), dj.opened_groups(docs, ("DM",), chunks))
    assert rows.count() == n and rows.select("row_index").distinct().count() == n
    assert chunks.count() > 100
