"""Tables written once and read several times, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_noted = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local session.

    A session on a cluster without that setting is refused, since its executors would not see a
    folder of the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="clinisieve-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables written inside; results must have been stored or collected by then.

    Tables are noted per thread of the driver, so other work of the session keeps its own.
    """
    outer, _noted.paths = getattr(_noted, "paths", None), []
    try:
        yield
    finally:
        paths, _noted.paths = _noted.paths, outer
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table, so later steps do not depend on earlier ones.

    The table survives the loss of executors, and its true size is known to the planner.
    """
    path = new_path(df.sparkSession, "table")
    if getattr(_noted, "paths", None) is not None:
        _noted.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
