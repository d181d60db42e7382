"""The domains derived from the given tables: written once, and uploaded without taking more disk than they must."""

import os

import pytest

from clinisieve.sources import files
from fixtures import documents as docs
from fixtures import tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def given(spark, tmp_path):
    spark.range(1, 40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 99).selectExpr(
        "id % 45 AS l_orderkey", "id AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity",
        "'A' AS l_returnflag", "TIMESTAMP_NTZ '1995-01-01 00:00:00' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 30).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_domains_are_derived_once(spark, given):
    for code, df in tables.domains(spark, given, ("dm", "vs", "ds", "eg")).items():
        assert "CASE" not in plan(df) and "Join" not in plan(df)
        own = tables.view(spark, given, code.lower())
        assert df.columns == own.columns and sorted(map(str, df.collect())) == sorted(map(str, own.collect()))


def test_large_uploads_are_compressed(spark, given, monkeypatch):
    kept = []
    monkeypatch.setattr(docs, "PLAIN_RECORDS", 50)
    monkeypatch.setattr(docs, "domains", lambda s, d: kept.append(tables.domains(s, d, ("dm", "vs"))) or kept[0])
    given_rows = {code: sorted(str(r) for r in tables.view(spark, given, code.lower()).drop("row_index").collect()) for code in ("DM", "VS")}
    for code, kind, path in docs.uploads(spark, given):
        names = [f for f in os.listdir(path) if f.startswith("part-")]
        assert kind == "json" and names and all(f.endswith(".txt.gz" if code == "VS" else ".txt") for f in names)
        read = files.read_json_records(spark, path)
        assert sorted(str(r) for r in read.select(*kept[0][code].columns).drop("row_index").collect()) == given_rows[code]
    for df in kept[0].values():
        assert not any(os.path.exists(f.removeprefix("file:")) for f in df.inputFiles())
