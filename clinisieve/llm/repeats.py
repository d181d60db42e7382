"""Removal of repeated byte strings, by prefix doubling over sorted positions.

A string of ``LENGTH`` bytes is repeated if it also starts in a document with a smaller id.  Names
(hashes) of growing prefixes are sorted by Spark; what has a unique name drops out at each level:

1. Of each window of ``LENGTH`` bytes the position whose ``SEED_LENGTH``-byte prefix hashes lowest is a
   seed.  Equal windows have equal seeds, so sorting the names of the seeds' prefixes brings
   all repeats together, at a tenth of the positions.  Seeds of a unique prefix drop out.
   Each seed also has the name of everything that windows around it can reach.  A seed whose
   surroundings occur in an earlier document settles all its windows at once; of seeds with equal
   surroundings only the first document's go on.
2. A window reaches half of what it can beyond its seed on one side at least.  So seeds go on only with a side, the seed
   and half the reach to the right or left of it, whose name other surroundings share.  The names of
   the sides are sorted.
3. Within a side, the pairs of names of the windows' halves are sorted, and a pair that an earlier
   document has is a repeat: the threshold is passed.

Copies of a passage are settled in level 1, many of them before any shuffle (a batch keeps only the
first document of equal surroundings), so a passage in a third of all documents costs a row per
batch.  A seed that very many different surroundings share streams through one task in bounded memory,
and the windows of a side with over ``HELD`` rows are sorted by Spark instead of in the side's task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.llm.common import LAST_ID, group_starts, runs_of, signed, slices, texts_as_bytes

LENGTH = 50
SEED_LENGTH = 16
#: Rows of one seed name that a task compares with each other; beyond, all of them go on to level 3.
HELD = 1 << 16
_SIDE = 10
#: What a code says of a seed: settled, or open to its right, its left, or both.
SETTLED, RIGHT, LEFT = 0, 1, 2
_STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64)


class Names:
    """Names of any substrings of a text, from prefix sums."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        if len(Names.up) < size:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            powers = [np.full(2 * size, x, np.uint64) for x in (_BASE, inverse)]
            for p in powers:
                p[0] = 1
            Names.up, Names.down = (np.multiply.accumulate(p) for p in powers)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(_BYTES[data] * Names.up[:size - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * Names.down[start] + (stop - start).astype(np.uint64))

    def all_of(self, length: int) -> np.ndarray:
        """Names of the substrings of one length at every start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * Names.down[:n] + np.uint64(length))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowest(names: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` names the place of the lowest, the leftmost of equal ones."""
    low, place, have = names, np.arange(len(names)), 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    return place


def _segments(size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows of a text in stretches [at, to), each within bytes [low, high) that hold all around them."""
    for at in range(0, size - length + 1, _STEP):
        to = min(at + _STEP, size - length + 1)
        yield at, to, max(0, at - length), min(size, to + 2 * length)


def seeds(data: np.ndarray, length: int, seed_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, surroundings, place) of every seed of one document."""
    size, width = len(data), length - seed_length + 1
    reach, half = length - seed_length, (length - seed_length) // 2
    bits = np.uint64(64 - _SIDE)
    found = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    for at, to, low, high in _segments(size, length):
        names = Names(data[low:high])
        prefixes = names.all_of(seed_length)
        place = _lowest(prefixes[at - low:to - low + width - 1], width) + at
        place = place[np.concatenate(([True], place[1:] != place[:-1]))]
        start, stop = np.maximum(place - reach, 0), np.minimum(place + length, size)
        clipped = ((place - start) << 8 | (stop - place)).astype(np.uint64)
        around = mix(names.of(start - low, stop - low) + clipped * _BASE)
        right = names.of(place - low, np.minimum(place + seed_length + half, size) - low)
        left = names.of(np.maximum(place - half, 0) - low, place + seed_length - low)
        around = (right >> bits) << bits | (left >> bits) << np.uint64(64 - 2 * _SIDE) | around >> np.uint64(2 * _SIDE)
        found.append((prefixes[place - low], around, place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _seed_rows(batches: Iterator[pa.RecordBatch], length: int, seed_length: int) -> Iterator[pa.RecordBatch]:
    """Rows (name, around, id, at, tag) of (id, tag, text); ``at`` is the place, or -1 less the place if settled here."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for part in slices(batch, 2):
            for doc_id, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_as_bytes(part.column(2)), strict=True):
                name, around, place = seeds(np.frombuffer(text, np.uint8), length, seed_length)
                for column, x in zip(columns, (name, around, np.full(len(place), doc_id), place, np.full(len(place), tag)), strict=True):
                    column.append(x)
        name, around, ids, at, tags = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
        if not len(name):
            continue
        name, around = name.view(np.int64), around.view(np.int64)
        order = np.lexsort((ids, around, name))
        starts = group_starts([name[order], around[order]])
        first = np.repeat(ids[order][starts], np.diff(np.append(starts, len(order))))
        settled = np.empty(len(order), bool)
        settled[order] = ids[order] > first
        # What is settled needs no partner any more; it goes along, dealt by its document.
        name = np.where(settled, ids * 31 + 7 + tags, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array(name), pa.array(np.where(settled, 0, around)), pa.array(ids), pa.array(np.where(settled, -1 - at, at)), pa.array(tags)],
            ["name", "around", "id", "at", "tag"])


def _shared(side: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether another member of the group has the same side."""
    order = np.lexsort((side, group))
    same = (side[order][1:] == side[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(side), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, code) from rows sorted by name, surroundings, id: settled seeds, and open ones that may share a window.

    Without a column of tags they are 0.
    """
    before = None
    for name, around, ids, at, *rest in runs_of(batches, 1, HELD):
        tags = rest[0] if rest else np.zeros(len(ids), np.int64)
        done = at < 0
        at = np.where(done, -1 - at, at)
        starts = group_starts([name, around])
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(name))))
        later = (ids > ids[starts][which]) & ~done
        # One member of each surroundings, whose sides are compared within the seed's name.
        own = group_starts([name])
        rows = np.diff(np.append(own, len(name)))
        groups = np.repeat(np.arange(len(own)), rows)[starts]
        sides = around[starts].view(np.uint64)
        cut = rows >= HELD  # such a name may go on in the next run
        cut[0] |= name[0] == before
        before = name[-1]
        right = _shared(sides >> np.uint64(64 - _SIDE), groups) | cut[groups]
        left = _shared(sides << np.uint64(_SIDE) >> np.uint64(64 - _SIDE), groups) | cut[groups]
        open_ = right * RIGHT + left * LEFT
        sides_open = np.where(later | done, 0, open_[which])
        kept = later | done | (sides_open > 0)
        code = at << 2 | sides_open
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(tags[kept]), pa.array(code[kept])], ["id", "tag", "code"])


def _covered(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges [begin, end)."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks)[:-1] > 0


def _settled(codes: list[int] | None, size: int, length: int, seed_length: int) -> np.ndarray:
    """Which windows of a text its settled seeds settle."""
    at = np.array([c >> 2 for c in codes or () if c & 3 == SETTLED], np.int64)
    last = max(0, size - length + 1)
    return _covered(np.maximum(at - (length - seed_length), 0), np.minimum(at + 1, last), last)


def _text(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(t) for t in texts_as_bytes(batch.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "tag", "packed"])


def _reaches(length: int, seed_length: int) -> dict[int, tuple[int, int]]:
    """For each side how far its windows start before the seed: from, to (both included)."""
    half = (length - seed_length) // 2
    return {RIGHT: (half - 1, 0), LEFT: (length - seed_length, half)}


def _side_rows(batches: Iterator[pa.RecordBatch], length: int, seed_length: int) -> Iterator[pa.RecordBatch]:
    """A row for each open side of a seed, of (id, tag, packed, codes): the name of the side and the bytes its windows reach.

    The bytes begin where the first window starts; what the text lacks is zeros, and ``low`` and ``high``
    bound the starts of real windows.
    """
    reaches, half = _reaches(length, seed_length), (length - seed_length) // 2
    for batch in batches:
        for part in slices(batch, 2):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, tag, packed, codes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not codes or not any(c & 3 for c in codes):
                    continue
                text = _text(packed)
                settled = _settled(codes, len(text), length, seed_length)
                for code in codes:
                    place = code >> 2
                    for side, (first, last) in reaches.items():
                        low, high = max(0, place - first), min(place - last, len(text) - length)
                        if not code & side or low > high or settled[low:high + 1].all():
                            continue
                        start = place - first
                        data = bytes(max(0, -start)) + text[max(0, start):place - last + length]
                        about = text[place:place + seed_length + half] if side == RIGHT else text[max(0, place - half):place + seed_length]
                        row = (signed(xxhash.xxh64_intdigest(about, side)), doc_id, place, side << 16 | (low - start) << 8 | (high - start),
                               data.ljust(first - last + length, b"\0"), tag)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int64())],
                    ["side", "id", "at", "bounds", "data", "tag"])


def _compare(batches: Iterator[pa.RecordBatch], length: int, seed_length: int) -> Iterator[pa.RecordBatch]:
    """(front, back, id, at, n, done, tag) of rows sorted by side and id: n windows from a place on.

    Windows that an earlier row of the side has come out as done; others of a side with very many rows
    come one by one, with the names of their halves.
    """
    reaches, half = _reaches(length, seed_length), length // 2
    before = None
    for side, ids, at, bounds, data, *rest in runs_of(batches, 1, HELD):
        tags = rest[0] if rest else np.zeros(len(ids), np.int64)
        own = group_starts([side])
        rows = np.diff(np.append(own, len(side)))
        cut = rows >= HELD
        cut[0] |= side[0] == before
        before = side[-1]
        group = np.repeat(np.arange(len(own)), rows)
        for kind, (first, last) in reaches.items():
            which = np.flatnonzero(bounds >> 16 == kind)
            starts = np.arange(first - last + 1)
            if not len(which):
                continue
            matrix = np.frombuffer(b"".join(data[which].tolist()), np.uint8).reshape(len(which), -1)
            Names(matrix[0])  # makes the powers long enough
            sums = np.zeros((len(which), matrix.shape[1] + 1), np.uint64)
            np.cumsum(_BYTES[matrix] * Names.up[:matrix.shape[1]], axis=1, out=sums[:, 1:])
            down = Names.down[starts]
            front = mix((sums[:, starts + half] - sums[:, starts]) * down)
            back = mix((sums[:, starts + length] - sums[:, starts + half]) * Names.down[starts + half])
            real = (starts >= (bounds[which] >> 8 & 255)[:, None]) & (starts <= (bounds[which] & 255)[:, None])
            row, offset = np.nonzero(real)
            front, back, owner = front[real], back[real], which[row]
            order = np.lexsort((ids[owner], back, front, offset, group[owner]))
            keys = [group[owner][order], offset[order], front[order], back[order]]
            begins = group_starts(keys)
            earliest = np.repeat(ids[owner][order][begins], np.diff(np.append(begins, len(order))))
            later = np.zeros(len(order), bool)
            later[order] = ids[owner][order] > earliest
            undecided = cut[group[owner]]
            place = at[owner] + starts[offset] - first
            # Neighbouring windows of a row that are done come out as one run.
            goes_on = np.zeros(len(later), bool)
            goes_on[1:] = later[1:] & later[:-1] & (owner[1:] == owner[:-1]) & (offset[1:] == offset[:-1] + 1)
            opens = np.flatnonzero(later & ~goes_on)
            runs = np.add.reduceat(later, opens, dtype=np.int64) if len(opens) else opens
            others = np.flatnonzero(undecided & ~later)
            chosen = np.concatenate((opens, others))
            done = np.arange(len(chosen)) < len(opens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(done, ids[owner[chosen]], front.view(np.int64)[chosen])),
                 pa.array(np.where(done, place[chosen], back.view(np.int64)[chosen])), pa.array(ids[owner[chosen]]), pa.array(place[chosen]),
                 pa.array(np.concatenate((runs, np.ones(len(others), np.int64))).astype(np.int32)), pa.array(done), pa.array(tags[owner[chosen]])],
                ["front", "back", "id", "at", "n", "done", "tag"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, seed_length: int) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, starts, stops, kept) of (id, tag, packed, codes, found)."""
    for batch in batches:
        for part in slices(batch, 2):
            rows: list[tuple] = []
            for doc_id, _, packed, codes, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text = _text(packed)
                windows = _settled(codes, len(text), length, seed_length)
                if found:
                    runs = np.array(found, np.int64)
                    windows = windows | _covered(runs >> 8, (runs >> 8) + (runs & 255), len(windows))
                marks = np.zeros(len(text) + 1, np.int64)
                at = np.flatnonzero(windows)
                marks[at] += 1
                marks[at + length] -= 1
                gone = np.cumsum(marks) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone))))
                kept = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes() if len(at) else text
                rows.append((doc_id, len(text), edges[::2].tolist(), edges[1::2].tolist(), kept))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["id", "n_bytes", "starts", "stops", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, starts, stops, kept) of every row: the removed runs of bytes, and the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also starts in a row of smaller id; matches stay
    within texts and are judged on the input.  Null and empty texts have no bytes.  Null ids come
    after all others; rows of one id never remove each other's bytes, and rows alike in id and text
    get equal results.  ``kept`` is bytes, as cuts may fall inside a character.  Other columns are not
    looked at, whatever their names.  An empty table gives an empty table.
    """
    if not 2 * SEED_LENGTH <= length <= 255:
        raise ValueError(f"strings must have {2 * SEED_LENGTH} to 255 bytes")
    ids = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Rows of one id are told apart by a hash of their texts; where ids are unique, no tag is shuffled.
    repeated = not docs.select(ids.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    base = docs.select(ids.alias("id"), (F.xxhash64(text) if repeated else F.lit(0).cast("bigint")).alias("tag"), text.alias("text"))
    keys, unused = (["id", "tag"], ()) if repeated else (["id"], ("tag",))
    sizes = {"length": length, "seed_length": SEED_LENGTH}
    rows = base.mapInArrow(lambda b: _seed_rows(b, **sizes), "name bigint, around bigint, id bigint, at bigint, tag bigint").drop(*unused)
    ordered = rows.repartition("name").sortWithinPartitions("name", "around", "id")
    codes = ordered.mapInArrow(_settle, "id bigint, tag bigint, code bigint").groupBy(*keys).agg(
        F.array_distinct(F.collect_list("code")).alias("codes"))
    texts = base.mapInArrow(_pack, "id bigint, tag bigint, packed binary")
    told = texts.join(codes, keys, "left").select("id", "tag", "packed", "codes")
    sides = told.mapInArrow(lambda b: _side_rows(b, **sizes), "side bigint, id bigint, at bigint, bounds bigint, data binary, tag bigint").drop(*unused)
    windows = sides.repartition("side").sortWithinPartitions("side", "id").mapInArrow(
        lambda b: _compare(b, **sizes), "front bigint, back bigint, id bigint, at bigint, n int, done boolean, tag bigint").drop(*unused)
    first = F.min("id").over(Window.partitionBy("front", "back"))
    later = windows.withColumn("first", first).where("done OR id > first").select(
        *keys, (F.shiftleft("at", 8) + F.col("n")).alias("run"))
    found = later.groupBy(*keys).agg(F.collect_set("run").alias("found"))
    # Rows equal in id and text are one row of ``found`` and ``codes`` each, which all of them take.
    cut = told.join(found, keys, "left").select("id", "tag", "packed", "codes", "found").mapInArrow(
        lambda b: _cut(b, **sizes), "id bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept binary")
    return cut.select(F.nullif("id", F.lit(LAST_ID)).alias(id_col), "n_bytes", "starts", "stops", "kept")
