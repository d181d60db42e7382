"""Audit rows of a stream whose state is kept for groups of records."""

from pyspark.sql import functions as F

from clinisieve.operators import changes
from clinisieve.streaming import changes as stream_changes

CONTENT = "id int, title string"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_audit_stream_keeps_groups_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_changes, "GROUPS", 2)
    folder, out, notes = (str(tmp_path / n) for n in ("in", "out", "notes"))
    before = spark.createDataFrame([(i, "a") for i in range(20)] + [(None, "n")], CONTENT)
    after = spark.createDataFrame([(i, "b" if i % 2 else "a") for i in range(5, 25)] + [(None, "m")], CONTENT)
    gone = before.join(after, "id", "left_anti").where("id IS NOT NULL").select("id", "title")
    want, empty = [], before.limit(0)
    for old, new, left in ((empty, before, empty), (before, after, gone)):
        rows = new.withColumns({"seq": F.lit(1), "deleted": F.lit(False)}).unionByName(left.withColumns({"seq": F.lit(1), "deleted": F.lit(True)}))
        rows.write.mode("append").parquet(folder)
        stream = stream_changes.audit_stream(spark.readStream.schema(rows.schema).parquet(folder), "studies")
        assert "pmod(xxhash64" in plan(stream)
        stream.writeStream.format("parquet").option("checkpointLocation", notes).option("path", out).trigger(availableNow=True).start().awaitTermination()
        diff = changes.audit_diff(old.where("id IS NOT NULL"), new.where("id IS NOT NULL"), "studies")
        want += [(r.action, str(r.target_id), r.before_hash, r.after_hash) for r in diff.collect()]
    found = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(r for r in found if r[1] is not None) == sorted(want)
    assert sorted(r[0] for r in found if r[1] is None) == ["studies.create", "studies.update"]
