"""Parts that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The characters that separate words, as a class of a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Null ids take part as the largest one.
LAST_ID = 2**63 - 1
#: Bytes of a long text that are taken apart at a time.
PIECE = 1 << 20


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a column of texts."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, room: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts take about ``room`` bytes; a longer text is a part by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.cumsum(lengths) // room
    cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, stop - start)


def pieces(text: bytes, gap: re.Pattern[bytes], room: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``room`` bytes, each of which begins where ``gap`` matches; one empty piece for an empty text."""
    start = 0
    while len(text) - start > room and (found := gap.search(text, start + room)):
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def signed(value: int) -> int:
    """A 64-bit pattern as the signed number that Spark's bigint holds."""
    return value - (1 << 64) if value >> 63 else value


def runs_of(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Sorted batches of numbers, cut so that rows equal in the first ``keys`` columns stay together.

    Only the last group of a batch is held back, so memory is bounded by a batch and one group; with
    ``most``, a group of so many rows or more is cut too.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        last = group_starts(columns[:keys])[-1]
        if most is not None and len(columns[0]) - last >= most:
            last = len(columns[0])
        if last:
            yield [c[:last] for c in columns]
        held = [c[last:] for c in columns] if last < len(columns[0]) else None
    if held is not None:
        yield held


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where the groups of sorted, non-empty key columns begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)
