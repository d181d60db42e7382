import os

import pytest
from pyspark.sql import functions as F

from clinisieve.findings import SCHEMA
from clinisieve.operators import changes
from clinisieve.plans import pipeline
from clinisieve.sources import sinks
from clinisieve.sources.store import Store


def found(spark, n, severity="LOW", start=0):
    rows = [("SDTM_RULE", f"R{i}", severity, "DM", "f", "m", i, "", "e") for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def stored(spark, path):
    return sorted((r.job_id, r.rule_id) for r in sinks.findings_store(path).read(spark).collect())


def test_a_repeated_job_replaces_its_findings_only(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stored(spark, path) == []
    counts = sinks.store_findings(found(spark, 3, "CRIT"), path, "T", "J1", "007")
    assert counts["total"] == 3 and counts["CRIT"] == 3 and counts["LOW"] == 0
    sinks.store_findings(found(spark, 2), path, "T", "J2", "007")
    other = files(path + "/tenant_id=T/study_id=007/job_id=J2")
    sinks.store_findings(found(spark, 2, start=5), path, "T", "J1", "007")
    assert stored(spark, path) == [("J1", "R5"), ("J1", "R6"), ("J2", "R0"), ("J2", "R1")]
    assert files(path + "/tenant_id=T/study_id=007/job_id=J2") == other
    assert {r.study_id for r in sinks.findings_store(path).read(spark).collect()} == {"007"}
    assert sinks.store_findings(found(spark, 2).where("false"), path, "T", "J1", "007")["total"] == 0
    assert sinks.store_findings(spark.createDataFrame([], SCHEMA), path, "T", "J9", "007")["total"] == 0
    assert stored(spark, path) == [("J2", "R0"), ("J2", "R1")]


def test_a_job_that_fails_half_way_leaves_the_earlier_findings(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.store_findings(found(spark, 3), path, "T", "J1", "S")
    broken = found(spark, 40).repartition(4).withColumn("message", F.when(F.col("row_index") == 33, F.raise_error(F.lit("lost"))).otherwise("m"))
    with pytest.raises(Exception, match="lost"):
        sinks.store_findings(broken, path, "T", "J1", "S")
    assert stored(spark, path) == [("J1", "R0"), ("J1", "R1"), ("J1", "R2")]
    sinks.store_findings(found(spark, 1), path, "T", "J1", "S")
    assert stored(spark, path) == [("J1", "R0")]
    with pytest.raises(Exception, match="must have a value"):
        sinks.store_findings(found(spark, 1), path, "", "J1", "S")


def test_run_job_twice(spark, tmp_path):
    (tmp_path / "dm.csv").write_text("STUDYID,USUBJID,SEX,RFSTDTC\nA,S1,Q,2024-01-01\n")
    job = ([("DM", "csv", str(tmp_path / "dm.csv"))], str(tmp_path / "store"))
    first, second = (pipeline.run_job(spark, *job, tenant_id="T", job_id="J", study_id="S") for _ in range(2))
    assert first == second and first["total"] == len(stored(spark, job[1])) > 0


def orders(spark, path):
    rows = spark.range(300).select("id", F.lit("open").alias("status"), F.lit(None).cast("string").alias("note"),
                                   F.concat(F.lit("P"), F.col("id") % 10).alias("p"), F.concat(F.lit("0"), F.col("id") % 2).alias("q"))
    own = Store(path, rows.schema, ("p", "q"))
    own.replace(rows)
    return own


def test_a_change_rewrites_touched_partitions_only(spark, tmp_path):
    own = orders(spark, str(tmp_path / "s"))
    before = files(own.path)
    edits = spark.createDataFrame([(13, "late"), (23, "late"), (44, "x"), (999, "none")], "id bigint, note string")
    assert own.change(edits, lambda rows: changes.partial_update(rows, "id", edits)) == 2
    kept = before & files(own.path)
    assert {f.split("/p=")[1][:2] for f in before - kept} == {"P3", "P4"} and len(kept) == len(before) - len(before - kept)
    rows = own.read(spark).collect()
    assert len(rows) == 300 and {(r.id, r.note) for r in rows if r.note} == {(13, "late"), (23, "late"), (44, "x")}
    assert {r.q for r in rows} == {"00", "01"}
    assert own.change(edits.where("id = 999"), lambda rows: rows) == 0


def test_requests_with_the_partition_prune_the_search(spark, tmp_path):
    own = orders(spark, str(tmp_path / "s"))
    gone = spark.createDataFrame([(13, "P3"), (14, "P3")], "id bigint, p string")  # 14 lies elsewhere, so it is not found
    assert own.change(gone, lambda rows: changes.soft_delete(rows, "id", gone.where("id % 10 = 3"))) == 1
    assert [r.id for r in own.read(spark).where("status = 'archived'").collect()] == [13]


def test_the_rewrite_reads_touched_folders_only(spark, tmp_path):
    own = orders(spark, str(tmp_path / "s"))
    touched = str(tmp_path / "t")
    spark.createDataFrame([("P3", "01")], "p string, q string").write.parquet(touched)
    df = own.read(spark).join(spark.read.parquet(touched).where("p >= '' AND q >= ''"), ["p", "q"], "left_semi")
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_rows_may_not_move(spark, tmp_path):
    own = orders(spark, str(tmp_path / "s"))
    edits = spark.createDataFrame([(13,)], "id bigint")
    with pytest.raises(ValueError, match="another"):
        own.change(edits, lambda rows: rows.withColumn("p", F.lit("P4")))
    assert own.read(spark).where("p = 'P3'").count() == 30
