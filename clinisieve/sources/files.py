"""Reading domain files: formats, CSV, JSON records, and row counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from clinisieve.functions.values import nulls_from_tokens
from clinisieve.operators.domains import DOMAINS
from clinisieve.operators.features import REQUIRED
from clinisieve.operators.rules import ROW_INDEX
from clinisieve.sources import csv_records, dataset_json
from clinisieve.sources.large_documents import split_large
from clinisieve.sources.rowid import with_row_index
from clinisieve.sources.scratch import written

# The formats that are accepted; a file name that says nothing is taken for JSON.
FORMATS = ("csv", "json", "dataset-json")


def with_format(df: DataFrame, filename: str, given: str) -> DataFrame:
    """Add ``format`` (the given one, or by the file name) and whether it is ``allowed``."""
    by_name = F.when(F.lower(filename).endswith(".csv"), "csv").otherwise("json")
    return df.withColumn("format", F.lower(F.coalesce(F.col(given), by_name))).withColumn(
        "allowed", F.col("format").isin(*FORMATS))


# Missing values and empty texts are read alike; a doubled quote inside quotes is one.
CSV_OPTIONS = dict(escape='"', nullValue="", emptyValue="")


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool | None = None) -> DataFrame:
    """A CSV table as texts, "no value" texts as nulls, rows numbered in file order.

    A file may have line breaks inside quotes, and is read in pieces either way.  Unless ``multiline`` says
    whether there are any, a pass over the files looks for a line that leaves a quote open.
    """
    if multiline is None:
        multiline = csv_records.has_breaks_in_quotes(spark, path)
    if multiline:
        return nulls_from_tokens(csv_records.read_records(spark, path, CSV_OPTIONS))
    raw = spark.read.options(header=True, inferSchema=False, enforceSchema=False, **CSV_OPTIONS).csv(path)
    return nulls_from_tokens(with_row_index(raw))


def read_generic(spark: SparkSession, path: str) -> DataFrame:
    """A flat file with one row per subject; it must have the required features."""
    df = read_csv(spark, path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Found: {df.columns}")
    return df


def read_study(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The domains of a folder of ``dm.csv``, ``vs.csv`` and so on; absent files are left out."""
    frames = {}
    for code in DOMAINS:
        try:
            frames[code] = read_csv(spark, os.path.join(folder, f"{code.lower()}.csv"))
        except AnalysisException as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
    return frames


def read_json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON documents that are a list of objects, or an object with them under ``records``; each as it is.

    Values are read as texts.  Records are numbered within their document.  An object without a list
    of records has no rows.  Each document is read by one task; several documents by several.
    """
    texts = spark.read.text(path, wholetext=True).select("value")
    wrapped = F.json_object_keys("value").isNotNull()
    listed = F.when(wrapped, F.get_json_object("value", "$.records")).otherwise(F.col("value"))
    records = texts.select(F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias(ROW_INDEX, "r")).where("r IS NOT NULL")
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys("r"))).distinct().collect())  # columns of a table
    return records.select(*[F.col("r").getItem(n).alias(n) for n in names if n != ROW_INDEX], F.col(ROW_INDEX).cast("bigint").alias(ROW_INDEX))


def read_dataset(spark: SparkSession, path: str, file_format: str, domain: str
                 ) -> tuple[DataFrame | None, DataFrame | None]:
    """One uploaded file as a domain's table, and what is wrong with its structure.

    An unknown format gives neither.  A Dataset-JSON document with a critical fault gives no table.
    """
    file_format = file_format.lower()
    if file_format == "csv":
        return read_csv(spark, path), None
    if file_format == "json":
        return read_json_records(spark, path), None
    if file_format != "dataset-json":
        return None, None
    docs, chunks = split_large(written(dataset_json.unwrap_envelopes(dataset_json.read_documents(spark, path))))
    broken = dataset_json.top_level_findings(docs)
    if not broken.isEmpty():
        return None, broken.drop(dataset_json.DOC)
    opened = dataset_json.opened_groups(docs, (domain,), chunks)
    found = dataset_json.group_findings(docs, (domain,), opened).unionByName(dataset_json.record_findings(docs, (domain,), opened))
    records = dataset_json.rows(docs, (domain,), opened)
    names = records.select(F.explode(dataset_json.PRESENT)).distinct().collect()  # columns of one file
    table = dataset_json.domain_table(records, domain, [r[0] for r in names]) if names else None
    return table, found.drop(dataset_json.DOC)


def csv_row_counts(spark: SparkSession, path: str | list[str], multiline: bool | None = None) -> DataFrame:
    """Rows per CSV file; ``multiline`` as for :func:`read_csv`."""
    if multiline is None:
        multiline = csv_records.has_breaks_in_quotes(spark, path)
    if multiline:
        return csv_records.record_counts(spark, path)
    rows = spark.read.options(header=True, inferSchema=False, escape='"').csv(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("row_count"))
