import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinisieve.operators import analytics, changes, joins, pages
from clinisieve.sources import rowid, scratch
from clinisieve.streaming import rules as stream_rules
from clinisieve.streaming import windows


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(i, "T1" if i % 3 else "T2", f"J{i % 2}", f"ST{i % 2}", f"R{i % 4}", ["LOW", "CRIT", "HIGH", "MED", "ODD"][i % 5],
             ["DM", "AE"][i % 2], "f", f"m{i}", i % 7, f"S{i % 5}", "", ["open", "resolved"][i % 2],
             datetime(2024, 1, 1 + (i * 7) % 28)) for i in range(120)]
    return spark.createDataFrame(
        rows, "id bigint, tenant_id string, job_id string, study_id string, rule_id string, severity string, domain string, "
              "field string, message string, row_index bigint, usubjid string, evidence string, status string, "
              "created_at timestamp_ntz")


RANK = {"CRIT": 0, "HIGH": 1, "MED": 2, "LOW": 3}


def test_listing_is_filtered_ranked_and_paged(findings):
    rows = [r for r in findings.collect() if r.tenant_id == "T1" and r.domain == "AE"]
    rows.sort(key=lambda r: (RANK.get(r.severity, 4), r.created_at, r.id))
    page = analytics.list_findings(findings, tenant_id="T1", domain="ae", offset=5, limit=10).collect()
    assert [r.id for r in page] == [r.id for r in rows[5:15]]
    assert analytics.list_findings(findings, severity="crit", status="OPEN", usubjid="S1").count() == len(
        [r for r in findings.collect() if (r.severity, r.status, r.usubjid) == ("CRIT", "open", "S1")])
    with pytest.raises(ValueError):
        analytics.list_findings(findings, limit=1001)


def test_report_order_and_top_findings(findings):
    rows = sorted(findings.collect(), key=lambda r: (r.domain, RANK.get(r.severity, 4), r.row_index, r.id))
    assert [r.id for r in analytics.report_order(findings).collect()] == [r.id for r in rows]
    assert [r.rule_id for r in analytics.report_detail(findings).collect()] == [r.rule_id for r in rows]
    top = analytics.top_findings_per_job(findings, 5)
    assert top.groupBy("job_id").count().filter("count <> 5").count() == 0
    # Only so many rows per job leave the map side.
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


def test_positions_follow_the_report(findings):
    rows = sorted(findings.collect(), key=lambda r: (r.domain, RANK.get(r.severity, 4), r.row_index, r.id))
    got = pages.positioned(findings.repartition(7), pages.report_order()).collect()
    assert {r.id: r.position for r in got} == {r.id: i for i, r in enumerate(rows)}
    assert {r.id: tuple(r)[:-1] for r in got} == {r.id: tuple(r) for r in rows}
    assert pages.positioned(findings.limit(0), pages.report_order()).count() == 0
    assert [tuple(r) for r in analytics.ranked_domains(findings).orderBy("position").collect()] == [("AE", 60, 0), ("DM", 60, 1)]


def test_summaries_hold_zeros(findings):
    got = analytics.summary_by_severity(findings.filter("severity = 'LOW'")).first()
    assert tuple(got) == (24, 0, 0, 0, 24)
    assert [tuple(r) for r in analytics.summary_by_domain(findings).collect()] == [("AE", 60), ("DM", 60)]
    assert {r.job_id: r.domains for r in analytics.domain_map(findings, ("job_id",)).collect()} == {
        "J0": {"DM": 60}, "J1": {"AE": 60}}


def test_rule_profiles(spark, findings):
    overrides = spark.createDataFrame([("R0", "HIGH", None), ("R1", None, False), ("R2", None, None)],
                                      "rule_id string, severity string, enabled boolean")
    got = analytics.apply_rule_profile(findings, overrides)
    assert got.columns == findings.columns
    assert got.filter("rule_id = 'R1'").count() == 0 and got.count() == 90
    assert {r.severity for r in got.filter("rule_id = 'R0'").collect()} == {"HIGH"}
    assert len({r.severity for r in got.filter("rule_id = 'R2'").collect()}) > 1


def test_resolutions(spark):
    stored = spark.createDataFrame(
        [(1, "open"), (2, "resolved"), (3, "open"), (4, "open")], "id bigint, status string").withColumns({
            c: F.lit(None).cast(t) for c, t in (("resolved_by", "string"), ("resolved_at", "timestamp"), ("resolution_note", "string"))})
    requests = spark.createDataFrame(
        [(10, 1, "waived", "U2", "2024-01-02", "b"), (11, 1, "resolved", "U1", "2024-01-01", "a"), (12, 2, "waived", "U1", "2024-01-01", ""),
         (13, 9, "waived", "U1", "2024-01-01", ""), (14, 3, "open", "U1", "2024-01-01", "")],
        "request_id bigint, id bigint, new_status string, user_id string, requested_at string, note string"
    ).withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    got = {r.id: (r.status, r.resolved_by, r.resolution_note) for r in changes.apply_resolutions(stored, requests).collect()}
    assert got == {1: ("resolved", "U1", "a"), 2: ("resolved", None, None), 3: ("open", None, None), 4: ("open", None, None)}
    rejects = {r.request_id: r.reason for r in changes.resolution_rejects(stored, requests).collect()}
    assert rejects == {10: "Finding is already closed by an earlier request.", 12: "Finding is already 'resolved'.",
                       13: "Finding not found.", 14: "status must be 'resolved' or 'waived'."}


def test_audit_and_updates(spark):
    before = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "id int, title string, status string")
    after = spark.createDataFrame([(1, "a", "x"), (2, "b", "None!"), (4, "d", "q")], "id int, title string, status string")
    got = {r.target_id: r for r in changes.audit_diff(before, after, "studies").collect()}
    assert {k: r.action for k, r in got.items()} == {2: "studies.update", 3: "studies.delete", 4: "studies.create"}
    assert got[2].before_hash == "" and len(got[2].after_hash) == 64
    assert len(got[3].before_hash) == 64 and got[3].after_hash == ""
    with pytest.raises(ValueError):
        changes.audit_diff(before, after, "tenants")
    edits = spark.createDataFrame([(2, None, "new")], "id int, title string, status string")
    assert sorted(tuple(r) for r in changes.partial_update(before, "id", edits).collect())[1] == (2, "b", "new")
    gone = changes.soft_delete(before, "id", edits)
    assert {r.id: r.status for r in gone.collect()} == {1: "x", 2: "archived", 3: "z"}


def test_hot_keys_are_split_by_spark(spark):
    """A key with most of the rows: its partition is read by several tasks, and no row is lost."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        events = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"))
        lookup = spark.range(97).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).union(
            spark.createDataFrame([("hot", 1000), ("k5", 1001)], "k string, v bigint"))
        joined = joins.lookup_join(events, lookup, ["k"], "left")
        assert joined.count() == 60_000 + events.filter("k = 'k5'").count()
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.collect()
        assert len(rows) and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_a_repeated_request_closes_a_finding_once(spark):
    findings = spark.createDataFrame([(1, "open", None, None, None)], "id bigint, status string, resolved_by string, resolved_at string, resolution_note string")
    requests = spark.createDataFrame([(7, 1, "waived", "U1", "2024-01-02", "n"), (7, 1, "waived", "U1", "2024-01-02", "n")],
                                     "request_id bigint, id bigint, new_status string, user_id string, requested_at string, note string")
    assert [(r.id, r.status, r.resolved_by) for r in changes.apply_resolutions(findings, requests).collect()] == [(1, "waived", "U1")]


def test_written_tables_are_cleared(spark):
    with scratch.cleared(spark):
        path = scratch.written(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
    assert scratch.scratch_dir(spark) == scratch.scratch_dir(spark)


def test_positions_among_findings(spark):
    rows = [("A", i * 3) for i in range(500)] + [("B", i) for i in range(20)]
    df = spark.createDataFrame(rows, "rule_id string, row_index bigint").repartition(4)
    got = rowid.position_among_findings(df, 64)
    assert got.filter("position <> IF(rule_id = 'A', row_index / 3, row_index)").count() == 0 and got.count() == 520


# --- windows and streams ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "rows")
    base = spark.range(2000).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("id") * 2)).alias("ts"),
        (F.col("id") % 4 == 0).alias("failed"), F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double").alias("ms"))
    base.write.parquet(path)
    return path


def test_windows(spark, events):
    df = spark.read.parquet(events)
    logins = windows.failed_login_windows(df, F.col("failed"), threshold=30)
    assert logins.count() == 13 and {r.failures for r in logins.collect()} <= {37, 38}
    rates = windows.error_rate_windows(df, F.col("failed"), threshold=0.12).collect()
    assert {r.requests for r in rates[:-1]} <= {30, 20} and all(r.alert == (r.failures / 60 > 0.12) for r in rates)
    p99 = windows.p99_windows(df, "ms", threshold=970.0)
    assert p99.count() == 67 and p99.filter("alert").count() == windows.p99_windows(
        df, "ms", threshold=970.0, only_alerts=True).count()


def test_windows_on_a_stream_equal_those_on_the_table(spark, events):
    table = spark.read.parquet(events)
    with pytest.raises(ValueError):
        windows.error_rate_windows(spark.readStream.schema(table.schema).parquet(events), F.col("failed"))
    stream = spark.readStream.schema(table.schema).parquet(events)
    out = windows.error_rate_windows(stream, F.col("failed"), watermark="10 seconds")
    query = out.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        query.processAllAvailable()
        got = sorted(map(str, spark.table("rates").collect()))
    finally:
        query.stop()
    assert got == sorted(map(str, windows.error_rate_windows(table, F.col("failed")).collect()))


def test_row_rules_on_a_stream(spark, table, tmp_path):
    rows = table("USUBJID AETERM AESTDTC", [("S1", "", "2024-01-01"), ("S9", "x", "bad"), ("", "x", None)])
    path = str(tmp_path / "ae")
    rows.write.parquet(path)
    dm = table("USUBJID", [("S1",)])
    stream = spark.readStream.schema(rows.schema).parquet(path)
    found = stream_rules.stream_row_rules(stream, "AE").unionByName(stream_rules.stream_dm_link(stream, dm, "AE"))
    query = found.writeStream.format("memory").queryName("found").start()
    try:
        query.processAllAvailable()
        got = sorted((r.rule_id, r.row_index) for r in spark.table("found").collect())
    finally:
        query.stop()
    assert got == [("SDTM_AE_001", 0), ("SDTM_AE_002", 1), ("X_DMLINK_AE_001", 1)]
