"""Records of CSV files with line breaks inside quotes, read in pieces like any other text file.

Whether a line break ends a record hangs on the quotes before it.  Each line maps the state it begins in
(outside or inside quotes) to the state it ends in; the maps of the lines of a piece make up the map
of the piece, and prefix sums over a file's pieces give the state and the number of records that each piece
begins with.  Records within a piece are put together by the task that reads it; only the lines of records
that cross a border between pieces are shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinisieve.operators.joins import lookup_join
from clinisieve.operators.rules import ROW_INDEX
from clinisieve.sources.scratch import written

_KEYS = ["file", "start"]
_PIECE = ("file string, start bigint, exit_closed boolean, ends_closed bigint, first_closed bigint, last_closed bigint, "
          "exit_open boolean, ends_open bigint, first_open bigint, last_open bigint")


def _ends_inside(line: Column) -> Column:
    """Whether a line that begins a field ends inside quotes.

    A quote opens a field only as its first character; doubled ones inside stand for one; what
    follows the closing one, up to the next comma, is text, and such a field keeps its quotes.
    """
    single = F.replace(line, F.lit('""'), F.lit(""))
    closed = F.regexp_replace(single, '(^|,)"[^"]*"[^,]*', "$1-")
    return F.when(F.contains(line, F.lit('"')), closed.rlike('(^|,)"')).otherwise(F.lit(False))


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start of the piece, id, value, closed, open): each line with the states it leads to; ids ascend within a piece."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("id"), "value", _ends_inside(value).alias("closed"),
                       _ends_inside(F.concat(F.lit('"'), value)).alias("open"), (F.trim(F.translate(value, "\r\t", "  ")) == "").alias("blank"))


def has_breaks_in_quotes(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line leaves a quote open, so that a record may have several lines."""
    return not spark.read.text(path).where(_ends_inside(F.col("value"))).isEmpty()


def _states(closed: np.ndarray, open_: np.ndarray, entry: bool) -> np.ndarray:
    """Whether one is inside quotes after each line, beginning with ``entry``."""
    place = np.arange(len(closed))
    last = np.maximum.accumulate(np.where(closed == open_, place, -1))
    flips = np.cumsum(closed & ~open_)
    since = flips - np.where(last >= 0, flips[last], 0)
    return np.where(last >= 0, closed[last], entry) ^ (since % 2 == 1)


def _ends(closed: np.ndarray, open_: np.ndarray, blank: np.ndarray, entry: bool) -> tuple[np.ndarray, bool]:
    """(lines that end a record, state after the last line); blank lines between records are none."""
    after = _states(closed, open_, entry)
    before = np.concatenate(([entry], after[:-1]))
    return np.flatnonzero(~after & ~(blank & ~before)), bool(after[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch cut where the piece changes."""
    files, starts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    at = 0
    for stop in [i for i in range(1, batch.num_rows) if starts[i] != starts[i - 1] or files[i] != files[i - 1]] + [batch.num_rows]:
        if stop > at:
            yield (files[at], int(starts[at])), batch.slice(at, stop - at)
        at = stop


def _flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(bool) for c in ("closed", "open", "blank")]


def _piece_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of every piece, from lines in order: for either state at its start the state, the records ended, the first and last end."""
    key, sides = None, []

    def row() -> dict:
        return {"file": key[0], "start": key[1]} | {
            f"{what}_{name}": side[what] for name, side in zip(("closed", "open"), sides, strict=True) for what in ("exit", "ends", "first", "last")}

    names = [f.split(" ") for f in _PIECE.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in names])
    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([row()], schema)
                key, sides = own, [{"exit": entry, "ends": 0, "first": None, "last": None} for entry in (False, True)]
            flags, ids = _flags(part), part.column(2).to_numpy()
            for side in sides:
                ends, side["exit"] = _ends(*flags, side["exit"])
                if len(ends):
                    side["first"] = int(ids[ends[0]]) if side["first"] is None else side["first"]
                    side["last"], side["ends"] = int(ids[ends[-1]]), side["ends"] + len(ends)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def pieces_of(lines: DataFrame) -> DataFrame:
    """(file, start, entry, number, ends, first, last) of every piece, stored.

    ``entry`` is the state that the piece begins in, ``number`` the records of the file that end before it,
    ``ends`` those that end in it, ``first`` and ``last`` the ids of the lines where the first and last of them do.
    """
    maps = lines.select(*_KEYS, "id", "closed", "open", "blank").mapInArrow(_piece_maps, _PIECE)
    in_file = Window.partitionBy("file").orderBy("start")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum((F.col("exit_closed") & ~F.col("exit_open")).cast("int")).over(so_far)
    fixed = F.when(F.col("exit_closed") == F.col("exit_open"), F.struct(F.col("exit_closed").alias("state"), F.col("flips")))
    known = maps.withColumn("flips", flips).withColumn("fixed", F.last(fixed, ignorenulls=True).over(so_far))
    after = F.coalesce(F.col("fixed.state"), F.lit(False)) != ((F.col("flips") - F.coalesce(F.col("fixed.flips"), F.lit(0))) % 2 == 1)
    known = known.withColumn("after", after).withColumn("entry", F.coalesce(F.lag("after").over(in_file), F.lit(False)))
    chosen = [F.when(F.col("entry"), F.col(f"{c}_open")).otherwise(F.col(f"{c}_closed")).alias(c) for c in ("ends", "first", "last")]
    counted = known.select(*_KEYS, "entry", "after", *chosen)
    return written(counted.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0))))


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, number, record) from the lines of whole records in order, with the number that each piece begins with."""
    key, number, held = None, 0, []
    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                key, number, held = own, part.column(part.schema.get_field_index("number"))[0].as_py(), []
            values = part.column(part.schema.get_field_index("value")).to_pylist()
            # The first line begins a record, or goes on with one that an earlier batch of the piece has begun.
            ends, inside = _ends(*_flags(part), bool(held))
            blank = part.column(part.schema.get_field_index("blank")).to_pylist()
            records, at = [], 0
            for end in ends.tolist():
                while not held and at < end and blank[at]:
                    at += 1
                records.append("\n".join([*held, *values[at:end + 1]]) if held or at < end else values[end])
                held, at = [], end + 1
            if inside:
                while not held and blank[at]:
                    at += 1
                held += values[at:]
            numbers = pa.array(range(number, number + len(records)), pa.int64())
            number += len(records)
            yield pa.RecordBatch.from_arrays([pa.array([own[0]] * len(records), pa.string()), numbers, pa.array(records, pa.string())], ["file", "number", "record"])


def records_of(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file, number, record) of every record, numbered within its file; the first one is the header."""
    placed = lookup_join(lines, pieces.select(*_KEYS, "entry", "number", "ends", "first", "last", "after"), _KEYS, "inner")
    # Of a piece that begins inside quotes, the lines up to the first end belong to an earlier piece's record.
    head = F.col("entry") & (F.col("first").isNull() | (F.col("id") <= F.col("first")))
    tail = F.col("after") & (F.col("last").isNull() | (F.col("id") > F.col("last")))
    inner = placed.where(~head & ~tail).select(*_KEYS, "id", "number", "value", "closed", "open", "blank", "entry")
    # A record that ends in the piece after beginning in another one has the piece's first number.
    inner = inner.withColumn("number", F.col("number") + F.col("entry").cast("bigint")).drop("entry")
    whole = inner.sortWithinPartitions(*_KEYS, "id").mapInArrow(_whole_records, "file string, number bigint, record string")
    # A tail has the number that follows the piece's last; so has the head of the next piece.
    number = F.when(head, F.col("number")).otherwise(F.col("number") + F.col("ends"))
    crossing = placed.where(head | tail).select("file", number.alias("number"), F.struct("start", "id", "value", "blank").alias("line"))
    parts = F.sort_array(F.collect_list("line"))
    joined = crossing.groupBy("file", "number").agg(parts.alias("lines")).select(
        "file", "number", F.array_join(F.transform(_without_leading_blanks(F.col("lines")), lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def headers_of(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file, record) of the first record of every file that has one, from the lines up to its end only.

    The piece that it ends in is the first one in which a record ends; a quote left open takes all lines.
    """
    end = F.min(F.when(F.col("first").isNotNull(), F.struct("start", "first"))).alias("end")
    ends = pieces.groupBy("file").agg(end, F.bool_or("after").alias("inside")).where("end IS NOT NULL OR inside")
    within = lookup_join(lines.select(*_KEYS, "id", "value", "blank"), ends, ["file"], "inner").where(
        "end IS NULL OR start < end.start OR (start = end.start AND id <= end.first)")
    parts = F.sort_array(F.collect_list(F.struct("start", "id", "value", "blank"))).alias("lines")
    record = F.array_join(F.transform(_without_leading_blanks(F.col("lines")), lambda x: x["value"]), "\n")
    return within.groupBy("file").agg(parts).select("file", F.regexp_replace(record, "\r$", "").alias("record"))


def _without_leading_blanks(lines: Column) -> Column:
    """Blank lines between records come before the line that opens one."""
    first = F.array_position(F.transform(lines, lambda x: x["blank"]), False)
    return F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))


def header_names(header: str) -> list[str]:
    """Column names of a header record: repeated ones get their position, empty ones are ``_c`` and theirs."""
    names = next(csv.reader([header]), [])
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_records(spark: SparkSession, path: str | list[str], options: dict) -> DataFrame:
    """The table of CSV files with a header each, numbered by ``row_index`` in the order of the files' names and records.

    Files may have line breaks inside quotes; lines end with ``\\n`` or ``\\r\\n``, and a break inside quotes stays as it is
    written.  A file of any size is read in pieces.  All files must have the same header.
    """
    lines = lines_of(spark, path)
    pieces = pieces_of(lines)
    records = records_of(lines, pieces)
    headers = written(headers_of(lines, pieces))
    first = headers.agg(F.min("record")).first()[0]
    if first is None:
        raise ValueError(f"no header in {path}")
    names = header_names(first)
    options = {**options, "multiLine": "true"}
    # One column more than expected, so that a longer header differs.
    wider = ", ".join(f"`c{i}` string" for i in range(len(names) + 1))
    if headers.select(F.from_csv("record", wider, options).alias("cells")).distinct().limit(2).count() > 1:
        raise ValueError(f"different headers in {path}")
    # A quote left open at a file's end is a record too, though it ends in no piece.
    last = F.max(F.struct("start", "after"))["after"].cast("bigint")
    files = pieces.groupBy("file").agg((F.sum("ends") + last - 1).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))  # a row per file
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    cells = F.from_csv("record", schema, options)
    table = lookup_join(records.where("number > 0"), files, ["file"], "inner").select(
        cells.alias("cells"), (F.col("offset") + F.col("number") - 1).alias(ROW_INDEX))
    return table.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)], ROW_INDEX)


def record_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_count): the records of each file without its header."""
    pieces = pieces_of(lines_of(spark, path))
    last = F.max(F.struct("start", "after"))["after"].cast("bigint")
    return pieces.groupBy("file").agg(F.greatest(F.sum("ends") + last - 1, F.lit(0)).alias("row_count"))
