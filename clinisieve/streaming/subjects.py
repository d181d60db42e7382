"""Checks between rows that arrive at different times: repeated subjects, and subjects that come late."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clinisieve.functions import values as v
from clinisieve.operators.cross import AE_IN_VS, CM_IN_VS, link_rule
from clinisieve.operators.domains import DUPLICATE
from clinisieve.operators.joins import lookup_join
from clinisieve.operators.rules import ROW_INDEX, Rule, evaluate
from clinisieve.operators.subjects import SUBJECT, distinct_subjects, subject

_COPY = f"{ROW_INDEX} bigint, USUBJID string, _subject string"


def stream_duplicate_subjects(dm: DataFrame) -> DataFrame:
    """Every copy of a subject that arriving demographics hold more than once, in whatever order and batches.

    State keeps the first copy of each subject; it is reported with the second one, later ones as they come.
    """
    def follow(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, text, reported = state.get if state.exists else (None, None, False)
        for part in parts:
            copies = part[[ROW_INDEX, "USUBJID", "_subject"]]
            if not state.exists and row is None and len(copies):
                row, text = int(copies.iloc[0, 0]), copies.iloc[0, 1]
                copies = copies.iloc[1:]
            if len(copies):
                if not reported:
                    reported = True
                    yield pd.DataFrame([(row, text, name[0])], columns=copies.columns)
                yield copies
        state.update((row, text, reported))

    filled = dm.where(~v.blank("USUBJID")).select(ROW_INDEX, "USUBJID", v.clean("USUBJID").alias("_subject"))
    copies = filled.groupBy("_subject").applyInPandasWithState(
        follow, _COPY, f"{ROW_INDEX} bigint, USUBJID string, reported boolean", "append", GroupStateTimeout.NoTimeout)
    return evaluate(copies, [DUPLICATE], domain="DM")


def _late_orphans(rows: DataFrame, parents: DataFrame, rule: Rule, time: str, wait: str, before: str,
                  watermark: str, known: DataFrame | None) -> DataFrame:
    events = rows.select(*[c for c in (ROW_INDEX, "USUBJID") if c in rows.columns], time, subject()).where(F.col(SUBJECT) != "")
    if known is not None:
        events = lookup_join(events, distinct_subjects(known), [SUBJECT], "left_anti")
    left = events.withWatermark(time, watermark)
    right = parents.select(subject().alias("_parent"), F.col(time).alias("_came")).withWatermark("_came", watermark)
    in_time = (F.col(SUBJECT) == F.col("_parent")) & (F.col("_came") >= F.col(time) - F.expr(f"INTERVAL {before}")) & (
        F.col("_came") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    orphans = left.join(right, in_time, "leftOuter").where("_parent IS NULL")
    return evaluate(orphans, [replace(rule, predicate="true")], domain="CROSS")


def stream_late_dm_link(rows: DataFrame, dm: DataFrame, code: str, time: str = "ts", *, wait: str = "1 day",
                        before: str = "30 days", watermark: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """Rows whose subject is neither in ``known`` nor arrives in the stream ``dm`` up to ``wait`` after the row.

    A row is reported once the watermark of both streams has passed its time and ``wait``, never
    when its subject came in time.  Subjects that came over ``before`` the row belong into ``known``, a table.
    """
    return _late_orphans(rows, dm, link_rule(code), time, wait, before, watermark, known)


def stream_late_vs_link(rows: DataFrame, vs: DataFrame, code: str, time: str = "ts", *, wait: str = "1 day",
                        before: str = "30 days", watermark: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """The same for adverse events (``AE``) or medications (``CM``) and the subjects of a stream of vital signs."""
    return _late_orphans(rows, vs, {"AE": AE_IN_VS, "CM": CM_IN_VS}[code], time, wait, before, watermark, known)
