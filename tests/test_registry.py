"""The driver's contract, and the registered queries against DuckDB on the smallest tables.

All queries are compared when ALL_QUERIES is set; otherwise a choice of them, one per kind.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import check

SF_DIR = "/root/testdata/sf0.001"
CHOICE = ["rule_dm_002", "rule_vs_004", "dmlink_ae", "x_vsae_002", "x_irt_002", "feature_frame", "validate_rules",
          "apply_resolutions", "report_detail", "dj_row_findings", "scan_domain", "p99_windows",
          "scan_breaks", "findings_stored_once", "edc_all_fields"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def test_contract(spark):
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
    assert entry_module.entry(spark).limit(1).count() == 1


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


NAMES = sorted(entry_module.oracle_sql()) if os.environ.get("ALL_QUERIES") else CHOICE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(name, spark, duck):
    df = entry_module.queries()[name](spark, SF_DIR)
    got = check.digest(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(entry_module.oracle_sql()[name])
    want = check.digest([d[0] for d in duck.description], duck.fetchall())
    assert got[:3] == want[:3]
