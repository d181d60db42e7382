"""Near-duplicates by SimHash, with tables of distances to pivots.

A fingerprint has 64 bits.  Equal fingerprints are one class from the start.  Two classes within d
bits agree on at least three of d + 3 blocks of bits, so the classes that agree on some three blocks
meet in one bucket for each choice of blocks.  In a bucket a table of Hamming distances to fixed
reference fingerprints, the pivots, is made once; a pair whose distances to some pivot differ by more
than d cannot be within d bits (triangle inequality) and is discarded; survivors are compared bit by
bit.  A bucket gives the links of a spanning forest, never all its pairs.  Buckets beyond ``BLOCK``
classes are cut into blocks and all pairs of blocks compared in tasks of their own, so no task holds
more than two blocks and no link is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.llm.common import PIECE, group_starts, pieces, runs_of, signed, texts_as_bytes
from clinisieve.llm.components import components
from clinisieve.sources.scratch import written

SEED = 42
PIVOTS = 24
BLOCK = 4096
_CHUNK = 1 << 16
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _add_shingles(ones: np.ndarray, words: list[bytes], width: int) -> None:
    """Count the set bits of the hashes of all shingles of these words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    stops = ends[-n:]
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at:min(n, at + _CHUNK)].tolist(), stops[at:at + _CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: bytes | None, width: int = 3, piece: int = PIECE) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero if it is null or has no word.  Long texts are taken apart in pieces of ``piece`` bytes."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for part in pieces(text or b"", _GAP, piece):
        words = held + part.lower().split()
        if len(words) >= width:
            _add_shingles(ones, words, width)
            n += len(words) - width + 1
            words = words[len(words) - width + 1:]
        held = words
    if not n:
        if not held:
            return 0
        _add_shingles(ones, held, len(held))
        n = 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint of a text, as a signed bigint.  Null and empty texts give zero."""
    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([signed(simhash(t, width)) for t in texts_as_bytes(column)], pa.int64())
    return of(text)


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def _spanning_links(bits: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the pairs within ``max_bits``; a member found once is not compared again."""
    left, queue = np.arange(1, len(bits)), [0]
    ones: list[int] = []
    others: list[int] = []
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        kept = np.abs(table[left] - table[at]).max(axis=1, initial=0) <= max_bits
        kept[kept] = np.bitwise_count(bits[left[kept]] ^ bits[at]) <= max_bits
        found = left[kept].tolist()
        ones += [at] * len(found)
        others += found
        queue += found
        left = left[~kept]
    return ones, others


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the buckets in rows sorted by (band, key, low, high), with the fingerprint last."""
    references = pivots()
    for columns in runs_of(batches, 4):
        bits = columns[4].view(np.uint64)
        table = np.bitwise_count(bits[:, None] ^ references).astype(np.int8)
        starts = group_starts(columns[:4])
        sizes = np.diff(np.append(starts, len(bits)))
        twos = starts[sizes == 2]
        twos = twos[np.abs(table[twos] - table[twos + 1]).max(axis=1, initial=0) <= max_bits]
        twos = twos[np.bitwise_count(bits[twos] ^ bits[twos + 1]) <= max_bits]
        a, b = [columns[4][twos]], [columns[4][twos + 1]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = slice(start, start + size)
            ones, others = _spanning_links(bits[own], table[own], max_bits)
            a.append(columns[4][own][ones])
            b.append(columns[4][own][others])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _masks(max_bits: int) -> list[int]:
    edges = [round(64 * i / (max_bits + 3)) for i in range(max_bits + 4)]
    blocks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:], strict=False)]
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def near_links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``max_bits``.  ``classes``: distinct ``fingerprint``."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(_masks(max_bits))])
    members = classes.select("fingerprint", F.explode(keys).alias("k")).select("k.band", "k.key", "fingerprint")
    crowded = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = (members.join(crowded, ["band", "key"])
             .select("band", "key", "fingerprint", blocks.alias("blocks"))
             .select("band", "key", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint"))
    by = ["band", "key", "low", "high"]
    return (dealt.repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(partial(_links, max_bits=max_bits), "a bigint, b bigint"))


def near_groups(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, component) of every row: texts linked, directly or through others, share a component.

    ``component_id`` is the smallest id of the component (null if all its ids are null), ``component``
    the smallest of its fingerprints as a signed number, which is never null.  Null texts, empty texts and texts without words have
    fingerprint zero and are linked like any other.  Repeated rows stay and share their component.
    Other columns are not looked at, whatever their names.  An empty table gives an empty table.
    """
    found = _grouped(docs, width, max_bits, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "fingerprint", "component_id", "component")


def _grouped(docs: DataFrame, width: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, text_hash, component_id, component) of every row."""
    marked = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fingerprint"),
                                 F.xxhash64(text_col).alias("text_hash")))
    classes = written(marked.groupBy("fingerprint").agg(F.min("id").alias("first")))
    roots = components(near_links(classes.select("fingerprint"), max_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("component"))
    rooted = written(rooted)
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "component").select("fingerprint", "component", "component_id")
    return marked.join(named, "fingerprint").select("id", "fingerprint", "text_hash", "component_id", "component")


def one_per_group(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays.

    Among rows of that same id the one with the smallest text stays (null texts first, then by all
    columns' hash); a component whose ids are all null keeps one row the same way.  All columns of
    ``docs`` are returned unchanged.
    """
    groups = _grouped(docs, width, max_bits, id_col, text_col)
    heads = groups.groupBy("component").agg(F.min("id").alias("head"))
    # A head's id may stand on rows of other texts too, and null ids on any; only rows of the component's own texts compete.
    own_id = heads.withColumnRenamed("component", "root")
    wanted = groups.join(own_id, (F.col("component") == F.col("root")) & F.col("id").eqNullSafe(F.col("head"))).select(
        "component", "head", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("own_hash"))
    own = rows.join(wanted, F.col(f"row.`{id_col}`").eqNullSafe(F.col("head")) & (F.col("own_hash") == F.col("text_hash")))
    order = F.struct(F.col(f"row.`{text_col}`"), F.xxhash64("row"))
    return own.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row.*")
