"""Loading the given tables and the study tables derived from them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.sources.scratch import written
from fixtures.store_views import STORE_VIEWS
from fixtures.views import DOMAIN_VIEWS

BASE_TABLES = ("customer", "orders", "lineitem", "events", "nation", "documents", "supplier",
               "conversations", "pages", "part")


# Several domains are taken from the lines with their orders.
_LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _register(spark: SparkSession, sf_dir: str, texts: list[str]) -> None:
    for name in BASE_TABLES:
        if any(re.search(rf"\b{name}\b", sql) for sql in texts):
            base(spark, sf_dir, name).createOrReplaceTempView(name)


def _domain(spark: SparkSession, name: str) -> DataFrame:
    df = spark.sql(DOMAIN_VIEWS[name])
    return df.withColumnRenamed("row_id", "row_index") if "row_id" in df.columns else df


def _line_domains(spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
    """The domains of lines and orders, from one join that is written with the columns of all of them side by side."""
    rows = [f"struct({DOMAIN_VIEWS[name].split('SELECT', 1)[1].split(_LINES)[0]}) AS {name}" for name in names]
    joined = spark.sql(f"SELECT {', '.join(rows)} {_LINES}")
    columns = {name: joined.schema[name].dataType.names for name in names}
    table = written(joined.select(*[F.col(f"{name}.{c}").alias(f"{name}_{c}") for name in names for c in columns[name]]))
    return {name: table.select(*[F.col(f"{name}_{c}").alias(c) for c in columns[name]]) for name in names}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL text over the given tables it names."""
    _register(spark, sf_dir, [sql])
    return spark.sql(sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; the ``row_id`` of a domain, if any, becomes ``row_index``."""
    if name in STORE_VIEWS:
        return derived(spark, sf_dir, STORE_VIEWS[name])
    _register(spark, sf_dir, [DOMAIN_VIEWS[name]])
    return _domain(spark, name)


def domains(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(DOMAIN_VIEWS)) -> dict[str, DataFrame]:
    """The derived domains by code, as stored tables.

    A validation reads each domain several times, as it would read a study's files, and would otherwise derive it anew
    each time, with the derivation of a column repeated wherever a filter names it.
    """
    _register(spark, sf_dir, [DOMAIN_VIEWS[name] for name in names])
    lines = [name for name in names if _LINES in DOMAIN_VIEWS[name]]
    tables = _line_domains(spark, lines) if lines else {}
    return {name.upper(): tables[name] if name in tables else written(_domain(spark, name)) for name in names}
