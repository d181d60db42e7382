import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a table of texts from (columns, rows), numbered by ``row_index``."""
    def build(columns, rows, numbered=True):
        names = columns.split()
        if numbered:
            rows = [(i, *r) for i, r in enumerate(rows)]
            schema = "row_index bigint, " + ", ".join(f"{n} string" for n in names)
        else:
            schema = ", ".join(f"{n} string" for n in names)
        return spark.createDataFrame(rows, schema)
    return build


@pytest.fixture(scope="session")
def hits():
    """(rule without prefix, row) of every finding."""
    def collect(findings):
        return sorted((r.rule_id, r.row_index) for r in findings.select("rule_id", "row_index").collect())
    return collect
