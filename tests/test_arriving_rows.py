import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinisieve.operators import changes, pages
from clinisieve.operators.domains import duplicate_subjects
from clinisieve.streaming import changes as stream_changes
from clinisieve.streaming import subjects as stream_subjects

START = datetime(2024, 1, 1)


def drain(df, out, notes):
    """Everything that has arrived, appended to ``out``."""
    df.writeStream.format("parquet").option("checkpointLocation", notes).option("path", out).trigger(availableNow=True).start().awaitTermination()


# --- audit rows -----------------------------------------------------------------------------------------

CONTENT = "id int, title string, status string"
SNAPSHOTS = [
    [(1, "a", "x"), (2, "b", None), (3, "c", "z")],
    [(1, "a", "x"), (2, "b", "None!"), (4, "d", "q")],
    [(1, "A", "x"), (3, "c", "z"), (4, "d", "q")],
    [],
]


def steps(spark):
    """(changes as they arrive, the audit rows that the two snapshots differ by) of every step."""
    before = spark.createDataFrame([], CONTENT)
    for rows in SNAPSHOTS:
        after = spark.createDataFrame(rows, CONTENT)
        gone = before.join(after, "id", "left_anti").select("id", "title", "status")
        arriving = after.withColumns({"seq": F.lit(1), "deleted": F.lit(False)}).unionByName(
            gone.withColumns({"seq": F.lit(1), "deleted": F.lit(True)}))
        yield arriving, changes.audit_diff(before, after, "studies")
        before = after


def test_audit_rows_of_batches_are_those_of_snapshots(spark, tmp_path):
    folder, out, notes = (str(tmp_path / n) for n in ("in", "out", "notes"))
    want = []
    for arriving, diff in steps(spark):
        arriving.write.mode("append").parquet(folder)
        # The query ends with every batch, and a new one goes on from the checkpoint.
        stream = spark.readStream.schema(arriving.schema).parquet(folder)
        drain(stream_changes.audit_stream(stream, "studies"), out, notes)
        want += [(r.action, str(r.target_id), r.before_hash, r.after_hash) for r in diff.collect()]
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(want)
    assert len(want) == 3 + 3 + 3 + 3
    with pytest.raises(ValueError):
        stream_changes.audit_stream(stream, "tenants")


def test_several_changes_of_a_record_in_one_batch(spark, tmp_path):
    rows = [(1, "b", 2, False), (1, "a", 1, False), (1, "b", 3, False), (1, None, 4, True), (2, "x", 1, True), (3, "y", 1, None), (3, "y", 2, False)]
    df = spark.createDataFrame(rows, "id int, title string, seq int, deleted boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(stream_changes.audit_stream(stream, "users"), str(tmp_path / "out"), str(tmp_path / "notes"))
    got = sorted((r.target_id, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("1", "users.create"), ("1", "users.delete"), ("1", "users.update"), ("3", "users.create")]


# --- repeated and late subjects ----------------------------------------------------------------------------

def test_copies_in_any_order_and_batch(spark, table, tmp_path, hits):
    names = ["S1", "S2", " S1", "S3", "", None, "S1", "S2 ", "S4", "S5", "S5"]
    dm = table("USUBJID SEX", [(n, "M") for n in names])
    folder, out, notes = (str(tmp_path / n) for n in ("in", "out", "notes"))
    for part in ([3, 6, 9], [0, 4, 7], [], [1, 2, 5, 8, 10]):
        dm.where(F.col("row_index").isin(part)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(dm.schema).parquet(folder)
        drain(stream_subjects.stream_duplicate_subjects(stream), out, notes)
    got = spark.read.parquet(out)
    want = duplicate_subjects(dm)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7


def arrive(spark, folder, rows):
    """Rows of (row, subject, hours after the start)."""
    data = [(i, s, START + timedelta(hours=h)) for i, s, h in rows]
    df = spark.createDataFrame(data, "row_index bigint, USUBJID string, ts timestamp")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


@pytest.mark.parametrize("link, rule", [(stream_subjects.stream_late_dm_link, "X_DMLINK_AE_001"), (stream_subjects.stream_late_vs_link, "X_VSAE_001")])
def test_orphans_are_reported_once_their_time_has_passed(spark, table, tmp_path, hits, link, rule):
    ae, dm, out, notes = (str(tmp_path / n) for n in ("ae", "dm", "out", "notes"))
    known = table("USUBJID", [("K1",)])

    def step(events, subjects):
        schema = arrive(spark, ae, events)
        arrive(spark, dm, subjects)
        rows, parents = (spark.readStream.schema(schema).parquet(f) for f in (ae, dm))
        drain(link(rows, parents, "AE", wait="24 hours", before="48 hours", watermark="1 hour", known=known), out, notes)
        return hits(spark.read.schema("rule_id string, row_index bigint").parquet(out))

    # S1 is there, S2 comes in time, S3 comes too late, S4 never; K1 was known, a blank subject is none.
    assert step([(0, "S1", 1), (1, " S2", 2), (2, "S3", 3), (3, "S4", 4), (4, "K1", 4), (5, "", 4)], [(0, "S1", 0)]) == []
    assert step([(6, "K1", 20)], [(1, "S2", 20)]) == []
    assert step([(7, "S5", 60)], [(2, "S3", 60)]) in ([], [(rule, 2), (rule, 3)])  # the watermark moves after a batch
    assert step([(8, "K1", 61)], [(3, "S5", 61)]) == [(rule, 2), (rule, 3)]
    assert step([(9, "K1", 200)], [(4, "S9", 200)]) in ([(rule, 2), (rule, 3)],)
    assert step([(10, "K1", 201)], [(5, "S9", 201)]) == [(rule, 2), (rule, 3)]


# --- counts and pages ----------------------------------------------------------------------------------------

def some_findings(spark, n):
    rows = [(i, f"T{i % 2}", f"J{i % 3}", ["DM", "AE"][i % 5 == 0], ["CRIT", "LOW", "HIGH", "MED", "ODD"][i % 5], START + timedelta(hours=i * 7 % 50)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, tenant_id string, job_id string, domain string, severity string, created_at timestamp")


def test_counts_are_kept_by_batch(spark, tmp_path):
    found, kept = some_findings(spark, 200), stream_changes.KeptCounts(str(tmp_path / "counts"))
    assert kept.by_severity(spark).collect() == []
    folder, notes = str(tmp_path / "in"), str(tmp_path / "notes")
    for part in range(3):
        found.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for repeated in range(2):  # the second query has lost its checkpoint and counts all batches again
        query = stream.writeStream.foreachBatch(kept.add).option("checkpointLocation", notes + str(repeated)).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {(r.tenant_id, r.job_id): (r.total, r.CRIT, r.LOW) for r in kept.by_severity(spark).collect()}
        want = {}
        for r in found.collect():
            total, crit, low = want.get((r.tenant_id, r.job_id), (0, 0, 0))
            want[r.tenant_id, r.job_id] = (total + 1, crit + (r.severity == "CRIT"), low + (r.severity == "LOW"))
        assert got == want
    kept.add(found.where("false"), 1)  # a batch that turns out empty
    assert sum(r.findings for r in kept.by_domain(spark).collect()) == found.where("id % 3 <> 1").count()


def test_pages_are_read_from_their_blocks(spark, tmp_path):
    found, path = some_findings(spark, 500).repartition(5), str(tmp_path / "pages")
    pages.lay_out(found, path, pages.findings_order(), ("tenant_id",), block=20)
    rank = {"CRIT": 0, "HIGH": 1, "MED": 2, "LOW": 3}
    rows = sorted((r for r in found.collect() if r.tenant_id == "T1"), key=lambda r: (rank.get(r.severity, 4), r.created_at, r.id))
    for offset, limit in ((0, 10), (35, 50), (245, 10), (400, 5)):
        got = pages.page(spark, path, offset, limit, block=20, tenant_id="T1").collect()
        assert [r.id for r in got] == [r.id for r in rows[offset:offset + limit]]
        assert [r.position for r in got] == list(range(offset, min(offset + limit, 250)))[:len(got)]
    deep = pages.page(spark, path, 235, 10, block=20, tenant_id="T1").drop("position")
    plan = deep._jdf.queryExecution().executedPlan().toString()
    # The folders to read are chosen by their names.
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert re.search(r"_block#\d+ >= 11\)", filters) and "T1" in filters
    newest = str(tmp_path / "newest")
    pages.lay_out(found, newest, pages.newest_first("id"), block=64)
    want = sorted(found.collect(), key=lambda r: r.id)
    want.sort(key=lambda r: r.created_at, reverse=True)
    assert [r.id for r in pages.page(spark, newest, 100, 70, block=64).collect()] == [r.id for r in want[100:170]]
    with pytest.raises(ValueError):
        pages.page(spark, newest, 0, 1001)
