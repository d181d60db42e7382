"""Large Dataset-JSON documents taken apart: the document without its records, and the records in chunks.

A parsed document is one value of bounded size, and its records would be one task's work.  Here a text is
walked once, token by token, without being parsed; the array under each ``itemData`` key gives way
to a mark, and its elements go on as rows of about a megabyte, which are parsed, checked and read by many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinisieve.sources.scratch import written

#: Bytes above which a document is taken apart, and characters of a chunk of records.
LARGE_BYTES, CHUNK = 8 << 20, 1 << 20
#: A record array lies under root, item groups, a group and this key.
RECORDS, DEPTH = "itemData", 4
#: White space is stepped over by the search; a string goes on over escaped characters.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},:]', re.S)
_BEGIN = re.compile(r"[ \t\r\n]*\[")
PART = "doc_id string, n int, part int, first bigint, good bigint, text string"


def mark(n: int) -> str:
    """What stands for the n-th array of records of a document."""
    return f"#{n}"


def _chunks(text: str, at: int, size: int) -> Iterator[tuple[int, int, str]]:
    """(first record, arrays among the records before it, JSON array) of the array that opens at ``at``; the last item is its end.

    Text that is no JSON ends where the text does.
    """
    depth, begin, element = 0, at + 1, at + 1
    first = number = good_before = good = 0
    stop = len(text)

    for token in _TOKEN.finditer(text, at):
        c = token.group()[0]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                stop = token.start()
                break
        elif c == "," and depth == 1:
            number, good, end = number + 1, good + (_BEGIN.match(text, element) is not None), token.start()
            element = token.end()
            if end - begin >= size:
                yield first, good_before, f"[{text[begin:end]}]"
                begin, first, good_before = element, number, good
    if number or text[begin:stop].strip(" \t\r\n"):
        yield first, good_before, f"[{text[begin:stop]}]"
    yield stop, -1, ""


def taken_apart(text: str, size: int = CHUNK) -> Iterator[tuple[int, int, int, str]]:
    """(n, first, good, JSON) of every chunk of the n-th array of records, and at last (-1, 0, 0, the rest of the document)."""
    kept, at, n = [], 0, 0
    open_, key, expects_key = [], None, False  # the kinds of the open containers, and the key in force in the last one
    tokens = _TOKEN.finditer(text)
    while (token := next(tokens, None)) is not None:
        c = token.group()[0]
        if c == '"':
            if expects_key:
                key, expects_key = token.group(), False
        elif c == "[" and len(open_) == DEPTH and key is not None and json.loads(key, strict=False) == RECORDS:
            stop = len(text)
            for first, good, chunk in _chunks(text, token.start(), size):
                if good >= 0:
                    yield n, first, good, chunk
                else:
                    stop = first
            kept += [text[at:token.start()], f'["{mark(n)}"']
            at, n, key = stop, n + 1, None
            tokens = _TOKEN.finditer(text, stop + 1)
        elif c in "[{":
            open_.append(c)
            key, expects_key = None, c == "{"
        elif c in "]}":
            del open_[-1:]
            key, expects_key = None, False
        elif c == ",":
            key, expects_key = None, open_[-1:] == ["{"]
    kept.append(text[at:])
    yield -1, 0, 0, "".join(kept)


def _part_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in PART.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            part, last = 0, -1
            for n, first, good, chunk in taken_apart(text.as_py(), size):
                part, last = (part + 1 if n == last else 0), n
                row = (doc_id.as_py(), n, part, first, good, chunk)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)


def split_large(docs: DataFrame, large: int | None = None, size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(documents, chunks of records): large documents with marks in place of their arrays of records.

    ``docs`` is a stored table of (doc_id, text).  Without a large document it comes back as it is, and
    there are no chunks.  A large document is walked by one task; its chunks are dealt to all.  A document with
    a chunk that is no JSON is none itself.  A text holds two gigabytes at most.
    """
    limit, size = LARGE_BYTES if large is None else large, size or CHUNK
    is_large = F.coalesce(F.octet_length("text") > limit, F.lit(False))
    if docs.where(is_large).isEmpty():
        return docs, None
    parts = docs.where(is_large).select(F.col("doc_id").cast("string"), "text").mapInArrow(lambda b: _part_rows(b, size), PART)
    parts = written(parts.repartition("doc_id", "n", "part").withColumn("records", F.expr(
        "CASE WHEN n >= 0 THEN try_variant_get(try_parse_json(text), '$', 'array<variant>') END")))
    broken = parts.where("n >= 0 AND records IS NULL").select("doc_id").distinct().withColumn("broken", F.lit(""))
    rest = parts.where("n < 0").join(broken, "doc_id", "left").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.coalesce("broken", "text").alias("text"))
    chunks = parts.where("n >= 0").select("doc_id", F.concat(F.lit("#"), F.col("n").cast("string")).alias("mark"), "part", "first", "good", "records")
    return docs.where(~is_large).select("doc_id", "text").unionByName(rest), chunks
