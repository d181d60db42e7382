"""Audit rows of records as they change, and counts of findings as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clinisieve import vocab
from clinisieve.functions.hashing import row_hash
from clinisieve.operators.analytics import severity_counts
from clinisieve.operators.changes import AUDITED
from clinisieve.sources.store import Store

_AUDIT = "action string, target_id string, before_hash string, after_hash string"


#: Groups that the records are dealt to; a batch calls Python once for each group that it touches, whatever the records in it.
GROUPS = 4096


def audit_stream(records: DataFrame, table: str, key: str = "id", order: str = "seq", deleted: str = "deleted") -> DataFrame:
    """One row per record of the stream that creates, changes or deletes something.

    A row of the stream is the new content of a record, or says that the record is ``deleted``; rows of a
    record that come together are taken by ``order``.  State is the last hash of each record, kept for groups of records
    that are dealt by a hash of the key, so a
    record that comes again unchanged gives nothing, and neither does the deletion of an unknown one.  The rows
    are those of :func:`clinisieve.operators.changes.audit_diff` between what came before and after.
    """
    if table not in AUDITED:
        raise ValueError(f"{table} is not audited")
    content = [c for c in records.columns if c not in (order, deleted)]

    def follow(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = (dict(zip(*state.get, strict=True)) if state.exists else {}), []
        rows = pd.concat(list(parts)).sort_values("place", kind="stable")  # the changes of one record in a batch
        for record, new, gone in zip(rows["target_id"], rows["hash"], rows["gone"], strict=True):
            seen, after = known.get(record), None if gone else new
            if after != seen:
                verb = "create" if seen is None else "delete" if after is None else "update"
                out.append((f"{table}.{verb}", record, seen if after is None else "", after or ""))
            if after is not None:
                known[record] = after
            else:
                known.pop(record, None)
        if known:
            state.update((list(known), list(known.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["action", "target_id", "before_hash", "after_hash"])

    target = F.col(key).cast("string")
    hashed = records.select(F.pmod(F.xxhash64(target), F.lit(GROUPS)).alias("group"), target.alias("target_id"), F.col(order).alias("place"),
                            F.coalesce(F.col(deleted), F.lit(False)).alias("gone"), row_hash(content).alias("hash"))
    return hashed.groupBy("group").applyInPandasWithState(
        follow, _AUDIT, "ids array<string>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)


class KeptCounts:
    """Findings counted as they arrive: each batch adds its own counts once, however often it is run.

    Counts are sums, so those of all batches are merged when they are read; a batch that is repeated after a
    failure replaces its own.
    """

    def __init__(self, path: str, by: tuple[str, ...] = ("tenant_id", "job_id")):
        self.by = by
        self.sums = ("total", *vocab.SEVERITIES)
        names = [T.StructField(c, T.StringType()) for c in ("batch", *by, "domain")]
        self.store = Store(path, T.StructType([*names, *(T.StructField(c, T.LongType()) for c in self.sums)]), ("batch",))

    def add(self, findings: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: count the findings of a batch."""
        counts = findings.groupBy(*self.by, "domain").agg(*severity_counts())
        # A row without findings stands for the batch, so that one that turns out empty replaces its old counts too.
        none = findings.sparkSession.range(1).select(
            *[F.lit(None).cast("string").alias(c) for c in (*self.by, "domain")], *[F.lit(0).cast("bigint").alias(c) for c in self.sums])
        self.store.replace(counts.unionByName(none).withColumn("batch", F.lit(f"b{batch_id}")))

    def by_severity(self, spark: SparkSession) -> DataFrame:
        """Total and severities per job."""
        return self.store.read(spark).where("total > 0").groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in self.sums])

    def by_domain(self, spark: SparkSession) -> DataFrame:
        """Findings per domain of each job."""
        return self.store.read(spark).where("total > 0").groupBy(*self.by, "domain").agg(F.sum("total").alias("findings"))
