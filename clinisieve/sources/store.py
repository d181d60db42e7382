"""Stored tables that are changed in place: whole partitions are replaced, all others keep their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.sources.scratch import written


@dataclass(frozen=True)
class Store:
    """A Parquet table under ``path``, laid out by the columns ``by``: texts that are neither null nor empty."""

    path: str
    schema: T.StructType
    by: tuple[str, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it is now; a store that nothing was written to is empty.

        The schema is given, since texts that look like numbers would be taken for numbers in names of folders.
        """
        if not _exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Put ``rows`` in place of the partitions that they fall into.

        The rows are written aside and moved at the end, so a run that fails leaves the table as it
        was, and one that is repeated leaves one set of rows.
        """
        named = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.raise_error(F.lit(f"{c} must have a value"))).otherwise(F.col(c)).alias(c)
                 if c in self.by else F.col(c) for c in self.schema.names]
        rows.select(*named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)

    def remove(self, spark: SparkSession, **partition: str) -> None:
        """Delete the files of one partition."""
        own = reduce(and_, [F.col(c) == v for c, v in partition.items()])
        for row in self.read(spark).where(own).select(F.col("_metadata.file_path").alias("file")).distinct().collect():
            place = spark._jvm.org.apache.hadoop.fs.Path(row["file"])
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, False)

    def change(self, requests: DataFrame, apply: Callable[[DataFrame], DataFrame], key: str = "id") -> int:
        """Rewrite the partitions that hold a row which ``requests`` name by ``key``; the number of them.

        ``apply`` is given the rows of those partitions and must return each of them, changed or not, in its
        partition.  Columns of ``by`` that the requests have narrow the search.  The new rows are stored whole before they take
        the old ones' place; until then a reader sees the old ones.
        """
        spark = requests.sparkSession
        table = self.read(spark)
        on = [key, *[c for c in self.by if c in requests.columns]]
        hit = table.select(*dict.fromkeys([key, *self.by])).join(requests.select(*on).distinct(), on, "left_semi")
        touched = written(hit.select(*self.by).distinct())
        number = touched.count()
        if not number:
            return 0
        # The comparison lets the planner prune the folders by what the small table turns out to hold.
        own = table.join(touched.where(reduce(and_, [F.col(c) >= "" for c in self.by])), list(self.by), "left_semi").select(*self.schema.names)
        changed = written(apply(own).select(*self.schema.names))
        if not changed.select(*self.by).distinct().join(touched, list(self.by), "left_anti").isEmpty():
            raise ValueError(f"a change must not move rows to another {' / '.join(self.by)}")
        self.replace(changed)
        return number


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
