"""The findings table: its schema, and findings that concern a whole dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order and kinds of the findings table.
SCHEMA = T.StructType([
    T.StructField("finding_type", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("usubjid", T.StringType()),
    T.StructField("evidence", T.StringType()),
])
COLUMNS = SCHEMA.fieldNames()

# Finding types, and the row index of a finding about a whole dataset.
SDTM_RULE, CROSS_DOMAIN, DATASET_JSON, ANOMALY = "SDTM_RULE", "CROSS_DOMAIN", "DATASET_JSON", "ANOMALY"
DATASET_LEVEL = -1


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def finding_columns(*, finding_type: str, rule_id, severity, domain, field, message,
                    row_index: Column | int = DATASET_LEVEL, usubjid: Column | str = "",
                    evidence: Column | str = "") -> list[Column]:
    """The nine columns; a plain value becomes a literal."""
    given = dict(finding_type=finding_type, rule_id=rule_id, severity=severity, domain=domain,
                 field=field, message=message, row_index=row_index, usubjid=usubjid,
                 evidence=evidence)
    return [
        (given[f.name] if isinstance(given[f.name], Column) else F.lit(given[f.name]))
        .cast(f.dataType).alias(f.name)
        for f in SCHEMA
    ]


def dataset_finding(df: DataFrame, *, scope: tuple[str, ...] = (), **columns) -> DataFrame:
    """One finding about ``df`` as a whole, none when it is empty; with a scope, one per scope."""
    rows = df.select(*scope).distinct() if scope else df.limit(1)
    return rows.select(*scope, *finding_columns(**columns))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, copies included."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_text(c: Column) -> Column:
    """A raw value as evidence: null becomes empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))
