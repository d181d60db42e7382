"""Listings laid out so that any page, however deep, is read from the few blocks that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinisieve.operators.analytics import MAX_PAGE, severity_rank
from clinisieve.operators.joins import lookup_join
from clinisieve.sources.scratch import written

#: Rows of a block.
BLOCK = 100_000
POSITION, NUMBER = "position", "_block"


def findings_order() -> list[tuple[Column, bool]]:
    """The worst first, then the oldest: expressions, and whether they descend."""
    return [(severity_rank(), False), (F.col("created_at"), False), (F.col("id"), False)]


def newest_first(key: str) -> list[tuple[Column, bool]]:
    return [(F.col("created_at"), True), (F.col(key), False)]


def report_order() -> list[tuple[Column, bool]]:
    """By domain, then the worst first, then by row."""
    return [(F.col("domain"), False), (severity_rank(), False), (F.col("row_index"), False), (F.col("id"), False)]


def positioned(df: DataFrame, order: list[tuple[Column, bool]], scope: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ``position`` of each row, from 0, in the given order within its ``scope``.

    Rows are sorted by ranges, and the sizes of the ranges summed up, so no task sees more than a range.  The
    order must end with a key; nulls come first where it ascends and last where it descends.
    """
    keyed = df.withColumns({f"_order{i}": c for i, (c, _) in enumerate(order)})
    names = [F.col(f"_order{i}").desc() if down else F.col(f"_order{i}").asc() for i, (_, down) in enumerate(order)]
    spread = keyed.repartitionByRange(*scope, *names).sortWithinPartitions(*scope, *names)
    placed = written(spread.select(*df.columns, F.monotonically_increasing_id().alias("_at"))).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(*scope, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*scope, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = lookup_join(placed, starts, [*scope, "_part"], "inner")
    return rows.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(POSITION))


def lay_out(df: DataFrame, path: str, order: list[tuple[Column, bool]], scope: tuple[str, ...] = (), block: int = BLOCK) -> None:
    """Write ``df`` with its positions in the given order, see ``positioned``, in folders of ``block`` positions per ``scope``."""
    rows = positioned(df, order, scope).withColumn(NUMBER, F.floor(F.col(POSITION) / block))
    rows.write.partitionBy(*scope, NUMBER).parquet(path)


def page(spark: SparkSession, path: str, offset: int, limit: int, block: int = BLOCK, **scope: str) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a layout, in order and with their ``position``; only the folders that hold them are read."""
    if not 0 < limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    rows = spark.read.parquet(path)
    for name, value in scope.items():
        rows = rows.where(F.col(name).eqNullSafe(value) if value is not None else F.lit(False))
    held = rows.where(F.col(NUMBER).between(offset // block, (offset + limit - 1) // block))
    return held.where(F.col(POSITION).between(offset, offset + limit - 1)).orderBy(POSITION).drop(NUMBER)
