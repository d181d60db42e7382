"""Files and documents that Spark derives from the given tables, for the readers to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.sources import sinks
from clinisieve.sources.scratch import cleared, new_path
from fixtures.tables import base, derived, domains, view

# Subjects, and adverse events, per document; a document is small whatever the tables' size.
DM_PER_DOC, AE_PER_DOC = 100, 1000
# Documents of an uploaded domain at most; those of a larger one grow.
DOCS = 2000
# An uploaded domain of more records than this comes compressed, as its names are repeated in every record.
PLAIN_RECORDS = 100_000

GENERIC = """
SELECT c_custkey AS row_id, CAST(1000 + c_custkey AS STRING) AS PATIENT_ID,
 CASE c_custkey % 40 WHEN 7 THEN '150' WHEN 8 THEN 'n/a' WHEN 9 THEN '17' ELSE CAST(20 + c_custkey % 60 AS STRING) END AS AGE,
 CASE c_custkey % 45 WHEN 3 THEN '250.0' WHEN 4 THEN NULL WHEN 5 THEN '89.9' WHEN 6 THEN '1O0' ELSE CAST(100 + c_custkey % 70 AS STRING) || '.5' END AS SYSBP,
 CASE c_custkey % 30 WHEN 2 THEN NULL WHEN 3 THEN 'NULL' ELSE '2025-01-01' END AS VSDTC,
 CASE c_custkey % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '50.0' WHEN 2 THEN '100.0' ELSE '-1' END AS DOSE FROM customer"""


def csv_copy(rows: DataFrame, order: str, drop: bool = True) -> str:
    """Write a table as several CSV files whose order is that of a column, as many as a shuffle has partitions."""
    path = new_path(rows.sparkSession, "csv")
    sorted_rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    (sorted_rows.drop(order) if drop else sorted_rows).write.options(**sinks.CSV_OPTIONS).csv(path)
    return path


def generic_csv(spark: SparkSession, sf_dir: str) -> str:
    return csv_copy(derived(spark, sf_dir, GENERIC), "row_id")


def record_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents of up to a hundred demographics records, one per file."""
    dm = view(spark, sf_dir, "dm").select(F.col("row_index").alias("SEQ"), "USUBJID", "SEX", "AGE")
    docs = dm.groupBy(F.floor(F.col("SEQ") / DM_PER_DOC).alias("doc")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("SEQ", "USUBJID", "SEX", "AGE")))).alias("records"))
    text = F.concat(F.lit('{"note":"x","records":'), F.col("records"), F.lit("}"))
    path = new_path(spark, "json")
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _group(rows: DataFrame, per_doc: int, columns: list[str]) -> DataFrame:
    """(doc, records as JSON): some records are cut short, some are no arrays."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    record = (F.when(F.col("row_index") % 77 == 5, F.lit('"broken"'))
              .when(F.col("row_index") % 50 == 3, F.to_json(F.slice(cells, 1, len(columns) - 1)))
              .otherwise(F.to_json(cells)))
    doc = F.floor(F.col("row_index") / per_doc).cast("bigint").alias("doc")
    return rows.select(doc, F.struct("row_index", record.alias("r")).alias("x")).groupBy("doc").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]), ",").alias("records"))


DM_COLUMNS = ["USUBJID", "STUDYID", "SEX", "AGE", "AGEU", "RFSTDTC", "RFENDTC"]
AE_COLUMNS = ["USUBJID", "AETERM", "AESTDTC", "AEENDTC", "AESER", "AESEV"]


def dataset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset-JSON documents with demographics and adverse events, some of them malformed."""
    dm = _group(view(spark, sf_dir, "dm"), DM_PER_DOC, DM_COLUMNS)
    ae = _group(view(spark, sf_dir, "ae"), AE_PER_DOC, AE_COLUMNS).withColumnRenamed("records", "ae_records")

    def items(columns: list[str]) -> str:
        return "[" + ",".join(f'{{"OID":"IT.{c}","name":"{c}"}}' for c in columns) + "]"

    both = dm.join(ae, "doc", "left")
    dm_group = F.concat(F.lit('"IG.ONE":{"name":"dm","items":' + items(DM_COLUMNS) + ',"itemData":['),
                        F.col("records"), F.lit("]}"))
    ae_group = F.concat(F.lit('"IG.AE":{"items":' + items(AE_COLUMNS) + ',"itemData":['),
                        F.coalesce("ae_records", F.lit("")), F.lit("]}"))
    root = F.when(F.col("doc") % 2 == 0, F.lit("clinicalData")).otherwise(F.lit("referenceData"))
    whole = F.concat(F.lit('{"creationDateTime":"2024-01-01","'), root, F.lit('":{"itemGroupData":{'),
                     ae_group, F.lit(","), dm_group, F.lit("}}}"))
    text = (F.when(F.col("doc") % 7 == 6, F.lit("[]")).when(F.col("doc") % 11 == 5, F.lit('{"foo":1}'))
            .when(F.col("doc") % 13 == 4, F.lit('{"clinicalData":[1]}'))
            .when(F.col("doc") % 17 == 3, F.lit('{"referenceData":{}}'))
            .when(F.col("doc") % 19 == 2, F.lit('{"clinicalData":{"itemGroupData":"x"}}'))
            .otherwise(whole))
    return both.select(F.col("doc").cast("string").alias("doc_id"), text.alias("text"))


def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for every five thousand subjects, with some records cut short and some that are no arrays."""
    items = ",".join(f'{{"OID":"IT.{c}","name":"{c}"}}' for c in DM_COLUMNS)
    return _group(view(spark, sf_dir, "dm"), 5000, DM_COLUMNS).select(F.col("doc").cast("string").alias("doc_id"), F.concat(
        F.lit(f'{{"clinicalData":{{"itemGroupData":{{"IG.DM":{{"items":[{items}],"itemData":['), F.col("records"), F.lit("]}}}}")).alias("text"))


def mixed_record_files(spark: SparkSession, sf_dir: str, lists_only: bool) -> str:
    """Demographics records as lists, or by turns as lists and wrapped, next to documents without any."""
    dm = view(spark, sf_dir, "dm").select(F.col("row_index").alias("SEQ"), "USUBJID", "SEX", "AGE")
    docs = dm.groupBy(F.floor(F.col("SEQ") / DM_PER_DOC).alias("doc")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("SEQ", "USUBJID", "SEX", "AGE")))).alias("records"))
    wrapped = F.concat(F.lit('{"records":'), F.col("records"), F.lit("}"))
    text = F.col("records") if lists_only else F.when(F.col("doc") % 2 == 0, F.col("records")).otherwise(wrapped)
    texts = docs.select(text.alias("value"))
    if not lists_only:
        texts = texts.union(docs.select(F.explode(F.array(F.lit('{"records":[]}'), F.lit('{"note":"none"}'), F.lit("[]")))))
    path = new_path(spark, "json")
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return path


def uploads(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """(domain, format, folder) of every domain as JSON documents of about a thousand records, or of more in two thousand documents."""
    out = []
    with cleared(spark):  # the domains' tables are not needed once they are uploaded
        for code, table in domains(spark, sf_dir).items():
            df = table.drop("row_index")
            record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
            rows = df.select(record.alias("r"))
            count = table.count()
            docs = rows.groupBy(F.pmod(F.xxhash64("r"), F.lit(min(-(-count // AE_PER_DOC), DOCS) or 1)).alias("doc")).agg(
                F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
            path = new_path(spark, "upload")
            docs.select("value").write.option("maxRecordsPerFile", 1).text(path, compression="gzip" if count > PLAIN_RECORDS else "none")
            out.append((code, "json", path))
    return out


def _dm_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, records): demographics as arrays of values in the order of ``DM_COLUMNS``."""
    dm = view(spark, sf_dir, "dm")
    cells = F.to_json(F.array(*[F.col(c).cast("string") for c in DM_COLUMNS]))
    return dm.groupBy(F.floor(F.col("row_index") / DM_PER_DOC).cast("bigint").alias("doc")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", cells.alias("r")))), lambda x: x["r"]), ",").alias("records"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the flat layout: one group each, as columns and rows."""
    columns = ",".join(f'{{"itemOID":"IT.DM.{c}","name":"{c}"}}' for c in DM_COLUMNS)
    return _dm_arrays(spark, sf_dir).select(F.col("doc").cast("string").alias("doc_id"), F.concat(
        F.lit(f'{{"datasetJSONVersion":"1.1.0","itemGroupOID":"IG.DM","columns":[{columns}],"rows":['), F.col("records"), F.lit("]}")).alias("text"))


def faulty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose demographics group is sound, no object, or without items, records or names, by turns; every key is written twice."""
    items = "[" + ",".join(f'{{"OID":"IT.{c}","name":"{c}"}}' for c in DM_COLUMNS) + "]"
    group = F.element_at(F.array(
        F.concat(F.lit(f'{{"items":{items},"itemData":['), F.col("records"), F.lit("]}")), F.lit("5"), F.lit('{"items":[],"itemData":[]}'),
        F.concat(F.lit(f'{{"items":{items},"itemData":"'), F.col("doc").cast("string"), F.lit('"}')), F.lit('{"items":[1,2],"itemData":[]}')),
        (F.col("doc") % 5 + 1).cast("int"))
    return _dm_arrays(spark, sf_dir).select(F.col("doc").cast("string").alias("doc_id"), F.concat(
        F.lit('{"clinicalData":0,"clinicalData":{"itemGroupData":{"IG.DM":0,"IG.DM":'), group, F.lit("}}}")).alias("text"))


def form_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five forms of five fields, one field per nation."""
    kinds = ["text", "notes", "calc", "slider", "radio"]
    return base(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("position"),
        F.concat(F.lit("f_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "_"))).alias("field_name"),
        F.concat(F.lit("Form_"), F.col("n_regionkey").cast("string")).alias("form_name"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), F.pmod("n_nationkey", F.lit(5)) + 1).alias("field_type"),
        F.col("n_name").alias("field_label"))


def part_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field per part: forms of about twenty fields each, some fields without a form, a type or a label."""
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("text", "notes", "calc", "Slider", "radio")])
    return base(spark, sf_dir, "part").select(
        key.alias("position"), F.concat(F.lit("f_"), key.cast("string")).alias("field_name"),
        F.when(key % 37 > 0, F.concat(F.lit("Form_"), F.floor(key / 20).cast("string"))).alias("form_name"),
        F.when(key % 11 > 0, F.get(kinds, (key % 5).cast("int"))).alias("field_type"),
        F.when(key % 13 > 0, F.col("p_name")).alias("field_label"))


def form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per customer with values for the field of its nation and of the next one."""
    customer, metadata = base(spark, sf_dir, "customer"), form_metadata(spark, sf_dir)
    here = metadata.select(F.col("position").alias("c_nationkey"), F.col("field_name").alias("here"))
    after = metadata.select(F.pmod(F.col("position") - 1, F.lit(25)).alias("c_nationkey"),
                            F.col("field_name").alias("after"))
    named = customer.join(here, "c_nationkey").join(after, "c_nationkey")
    record = F.map_from_arrays(
        F.array(F.lit("record_id"), F.col("here"), F.col("after")),
        F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_name")))
    return named.select(F.col("c_custkey").alias("record_id"), F.to_json(record).alias("record"))


def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per customer, with some fields left out."""
    key = F.col("c_custkey")
    return base(spark, sf_dir, "customer").select(F.to_json(F.struct(
        key.cast("string").alias("project_id"), F.col("c_name").alias("project_title"),
        F.when(key % 3 > 0, key % 2).alias("is_longitudinal"),
        F.when(key % 4 == 0, F.lit("other purpose")).alias("purpose_other"),
        F.col("c_mktsegment").alias("purpose"))).alias("project"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text made of the events, with lines that are no entries in between."""
    events = base(spark, sf_dir, "events")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    line = F.concat(at, F.lit(" ["), level, F.lit("] event "), F.col("event_id").cast("string"), F.lit(" by user "),
                    F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.lit("")))
    broken = F.concat(F.lit("Traceback of event "), F.col("event_id").cast("string"))
    return events.select(F.when(F.col("event_id") % 10 == 7, broken).otherwise(line).alias("value"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "log")
    log_lines(spark, sf_dir).write.text(path)
    return path
