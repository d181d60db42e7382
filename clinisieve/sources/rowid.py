"""Row positions: in file order for text files, by row index for Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.operators.joins import lookup_join
from clinisieve.operators.rules import ROW_INDEX


def _with_offsets(df: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add the number of rows in front of each piece (file, or part of a file)."""
    files = pieces.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    before_file = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before_file), F.lit(0)).alias("_files_before"))
    in_file = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).join(files, "_file")
    return lookup_join(df, offsets.select(
        "_file", "_start", "_first", (F.col("_files_before") + F.col("_before")).alias("_offset")),
        ["_file", "_start"], "inner")


def with_row_index(df: DataFrame) -> DataFrame:
    """Number the rows of a text-file scan from 0, in the order of the files' names and lines.

    Rows are counted per piece of a file (one row of bookkeeping per task, not per line) and the
    counts are summed up; rows are not moved.  ``df`` must come straight from ``spark.read``.
    """
    columns = df.columns
    marked = df.select(
        *[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = marked.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    numbered = _with_offsets(marked, pieces)
    return numbered.select(*[F.col(f"`{c}`") for c in columns],
                           (F.col("_id") - F.col("_first") + F.col("_offset")).alias(ROW_INDEX))


def with_parquet_row_index(df: DataFrame) -> DataFrame:
    """Number the rows of a Parquet scan from 0, in the order of the files' names and rows."""
    columns = df.columns
    marked = df.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias("_file"),
                       F.lit(0).alias("_start"), F.col("_metadata.row_index").alias("_id"))
    pieces = marked.groupBy("_file", "_start").agg(F.lit(0).alias("_first"), F.count(F.lit(1)).alias("_n"))
    numbered = _with_offsets(marked, pieces)
    return numbered.select(*[F.col(f"`{c}`") for c in columns],
                           (F.col("_id") + F.col("_offset")).alias(ROW_INDEX))


def position_among_findings(findings: DataFrame, block: int = 65_536) -> DataFrame:
    """Add ``position``, the place of a finding among those of its rule, in row order from 0.

    Older findings files number cross-domain findings that way.  Findings are numbered within
    blocks of rows, and the blocks' sizes are summed up, so a rule with most of the findings is
    still spread over many tasks.
    """
    marked = findings.withColumn("_block", F.floor(F.col(ROW_INDEX) / block))
    sizes = marked.groupBy("rule_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("rule_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("rule_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("rule_id", "_block").orderBy(ROW_INDEX)
    placed = marked.withColumn("_place", F.row_number().over(within)).join(offsets, ["rule_id", "_block"])
    return placed.withColumn("position", (F.col("_offset") + F.col("_place") - 1).cast("bigint")).drop(
        "_block", "_place", "_offset")
