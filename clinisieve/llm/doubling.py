"""Repeated byte strings by distributed prefix doubling.

Every position of every text is a pair of ranks: that of the bytes from it on, and that of the bytes
which follow those.  Spark sorts the pairs by ranges, and positions get the number of their pair in that order
as rank of a prefix twice as long.  Positions whose pair is unique drop out, as no longer prefix of theirs
repeats; the others are joined to the ranks at a growing offset until the prefix has the length
asked for.  The last offset is shorter, so that the two halves overlap.

Exact and simple, but the first level sorts a row for every byte of the corpus.  ``op5`` uses
``repeats``, which gives the same results from a sample of positions; see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve.llm.common import LAST_ID, slices, texts_as_bytes
from clinisieve.sources.scratch import written

#: Bytes of the first prefix: two ranks, each the value of eight bytes.
WIDTH = 16
#: Positions that are sent on at a time.
_CHUNK = 1 << 16
#: Bits for the number of a pair within its range.
_WITHIN = 40


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, rank, next) of all positions of (row, text) with ``WIDTH`` bytes from them on."""
    half = WIDTH // 2
    for batch in batches:
        for part in slices(batch, 1):
            for row, text in zip(part.column(0).to_pylist(), texts_as_bytes(part.column(1)), strict=True):
                data = np.frombuffer(text, np.uint8)
                for start in range(0, len(data) - WIDTH + 1, _CHUNK):
                    bytes_here = data[start:start + _CHUNK + WIDTH - 1]
                    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(bytes_here, half)).view(">i8").reshape(-1).astype(np.int64)
                    n = len(bytes_here) - WIDTH + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, row, np.int64)), pa.array(np.arange(start, start + n)), pa.array(eights[:n]), pa.array(eights[half:half + n])],
                        ["row", "at", "rank", "next"])


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, rank) of sorted (row, at, rank, next): the number of the pair, for pairs that occur more than once.

    Only the last row of a batch is held back, so a pair may occur any number of times.
    """
    number = TaskContext.get().partitionId() << _WITHIN
    held, held_same = [np.empty(0, np.int64)] * 4, False
    for batch in chain(batches, [None]):
        new = [] if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        row, at, first, second = [np.concatenate(x) for x in zip(held, new, strict=True)] if new else held
        if not len(row):
            continue
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        before, after = np.concatenate(([held_same], same)), np.concatenate((same, [False]))
        numbers = number + np.cumsum(~before)
        last = len(row) if batch is None else len(row) - 1
        chosen = (before | after)[:last]
        yield pa.RecordBatch.from_arrays([pa.array(x[:last][chosen]) for x in (row, at, numbers)], ["row", "at", "rank"])
        if last < len(row):
            number = int(numbers[last - 1]) if last else number
            held, held_same = [x[last:] for x in (row, at, first, second)], bool(before[last])


def _ranked(pairs: DataFrame) -> DataFrame:
    """(row, at, rank) of the positions whose pair is not unique, ranked in the order of all pairs."""
    ordered = pairs.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
    return written(ordered.mapInArrow(_ranks, "row bigint, at bigint, rank bigint"))


def repeated_positions(rows: DataFrame, length: int) -> DataFrame:
    """(row, at, rank) of the positions in (row, text) at which a string of ``length`` bytes starts that occurs more than once."""
    ranks, width = _ranked(rows.mapInArrow(_first_pairs, "row bigint, at bigint, rank bigint, next bigint")), WIDTH
    while width < length:
        offset = min(width, length - width)
        later = ranks.select("row", (F.col("at") - offset).alias("at"), F.col("rank").alias("next"))
        ranks, width = _ranked(ranks.join(later, ["row", "at"]).select("row", "at", "rank", "next")), width + offset
    return ranks


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, starts, stops, kept) of (id, text, found)."""
    for batch in batches:
        for part in slices(batch, 1):
            out: list[tuple] = []
            for key, text, found in zip(part.column(0).to_pylist(), texts_as_bytes(part.column(1)), part.column(2), strict=True):
                marks = np.zeros(len(text) + 1, np.int64)
                if found.is_valid:
                    at = found.values.to_numpy()
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + length, -1)
                gone = np.cumsum(marks) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone))))
                out.append((key, len(text), edges[::2].tolist(), edges[1::2].tolist(), np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["id", "n_bytes", "starts", "stops", "kept"])


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, starts, stops, kept) of every row, as ``repeats.without_repeats`` gives it: a byte goes if a string of
    ``length`` bytes over it also starts in a row of smaller id.

    Null and empty texts have no bytes.  Null ids come after all others; rows of one id never remove each
    other's bytes, and rows alike get equal results.  The found positions of a text are gathered for its
    cut.  Other columns are not looked at, whatever their names.  An empty table gives an empty table.
    """
    if length < WIDTH:
        raise ValueError(f"strings must have {WIDTH} bytes or more")
    ids = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    chosen = docs.select(ids.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = written(chosen.withColumn("row", F.monotonically_increasing_id()))
    found = repeated_positions(base.select("row", "text"), length).join(base.select("row", "id"), "row")
    firsts = found.groupBy("rank").agg(F.min("id").alias("first"))
    later = found.join(firsts, "rank").where("id > first").groupBy("row").agg(F.collect_list("at").alias("found"))
    cut = base.join(later, "row", "left").select("id", "text", "found").mapInArrow(
        lambda b: _cut(b, length), "id bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept binary")
    return cut.select(F.nullif("id", F.lit(LAST_ID)).alias(id_col), "n_bytes", "starts", "stops", "kept")
