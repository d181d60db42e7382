"""Hard negatives of anchors, by a vertical scan with branch and bound (BOND) over columnar dimensions.

Rows and anchors meet in cells: rows are dealt into groups, anchors into slices, and a cell is a
group with a slice, both of bounded size.  Within a cell the rows' components are columns.  An anchor reads
them in descending order of its own magnitudes and adds up partial products; what the unread columns
can still add lies between the sums of their least and greatest products, taken from every column's
minimum and maximum.  Rows whose bounds cannot reach a wanted place leave the candidate
bitmap, and the rest of the columns is read for the others only.  What is left at the end has exact scores.

The scan runs twice: for the best rows of an anchor's own label (its positives), and for the best rows of
other labels within the window of scores that each positive gives.  A cell hands on no more than the
places wanted for each anchor or window, so ties and copies cost no more than other rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.llm.common import LAST_ID
from clinisieve.sources.scratch import written

#: Rows and anchors of a cell, on average; one task holds both in memory.
ROWS_HELD = 1 << 17
ANCHORS_HELD = 1 << 17
#: A small table is still dealt into several groups for each core, of so many rows at least.
ROWS_LEAST = 1 << 10
#: Rows whose partial sums are worked on at once.
STRETCH = 1 << 13
#: Columns read between two looks at the bounds.
STEP = 8
SCALE = 256.0
#: Scaled components beyond this count as this, so that products add up within a bigint.
MOST = float(1 << 24)


def scaled(vector: Column) -> Column:
    """Whole numbers ``floor(256 x)`` of a vector's components, at most ``MOST`` in magnitude."""
    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * F.lit(SCALE), F.lit(MOST)), F.lit(-MOST))).cast("int")
    return F.transform(vector, whole)


def taking_part(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(row, id, label, vector) of the rows with a label and a whole, finite vector, stored."""
    vector = F.col(f"`{vector_col}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.where(label.isNotNull() & vector.isNotNull() & ~bad)
    return written(kept.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"),
                               label.cast("bigint").alias("label"), scaled(vector).alias("vector")))


class Columns:
    """The rows of a cell as columns of components, ordered by label, in stretches."""

    def __init__(self, table: pa.Table, width: int):
        row, ids, label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        order = np.argsort(label, kind="stable")
        self.row, self.id, self.label = row[order], ids[order], label[order]
        vectors = matrix(table.column("vector"), width)[order]
        self.stretches = []
        for at in range(0, len(order), STRETCH):
            part = np.ascontiguousarray(vectors[at:at + STRETCH].T)
            self.stretches.append((at, part, part.min(axis=1, initial=0), part.max(axis=1, initial=0)))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers; what short ones lack is 0."""
    column = vectors.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id, in that order."""
    if len(score) > 8 * most:
        near = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        # Ties at the last place may be very many; the smallest ids of them are enough.
        if len(near) > 8 * most:
            tied = near[score[near] == score[near].min()]
            near = np.concatenate((near[score[near] > score[near].min()], tied[np.argpartition(ids[tied], most - 1)[:most]] if len(tied) > most else tied))
        return near[np.lexsort((ids[near], -score[near]))][:most]
    return np.lexsort((ids, -score))[:most]


def scan(columns: Columns, vector: np.ndarray, wanted: Callable[[int, int], np.ndarray], low: list[int], high: list[int],
         most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window [low, high] of scores the best ``most`` rows of the cell: (scores, places).

    ``wanted`` gives the places of a stretch that may take part.  A row stays a candidate while some
    window can hold its score and, for all that is known, is not filled with better rows.
    """
    order = np.argsort(-np.abs(vector), kind="stable")
    order = order[vector[order] != 0]  # what is 0 adds nothing
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]
    for at, part, least, greatest in columns.stretches:
        places = wanted(at, at + part.shape[1])
        if not len(places):
            continue
        edges = vector[order].astype(np.int64) * np.stack((least[order], greatest[order]))
        # What the columns from a place in the order on can add: at least, at most.
        can_add = [np.append(np.cumsum(e[::-1])[::-1], 0) for e in (edges.min(axis=0), edges.max(axis=0))]
        alive = places - at
        whole = len(alive) == part.shape[1]
        kind = np.int32 if np.abs(edges).max(axis=0).sum() < 1 << 31 else np.int64
        sums, factors = np.zeros(len(alive), kind), vector.astype(kind)
        worst = [int(s[-1]) if len(s) == most else -(1 << 63) for s, _ in found]
        for start in range(0, len(order), STEP):
            for d in order[start:start + STEP]:
                sums += factors[d] * (part[d] if whole else part[d][alive])
            after = min(start + STEP, len(order))
            lowest, highest = (sums + c[after].astype(kind) for c in can_add)
            keep = np.zeros(len(sums), bool)
            for a, b, filled in zip(low, high, worst, strict=True):
                fits = (highest >= max(a, filled)) & (lowest <= b)
                sure = lowest[(lowest >= a) & (highest <= b)]
                if len(sure) >= most:
                    fits &= highest >= np.partition(sure, len(sure) - most)[len(sure) - most]
                keep |= fits
            if not keep.any():
                sums, alive = sums[:0], alive[:0]
                break
            if 4 * np.count_nonzero(keep) <= 3 * len(keep):
                sums, alive, whole = sums[keep], alive[keep], False
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            inside = (sums >= a) & (sums <= b)
            if inside.any():
                score = np.concatenate((found[i][0], sums[inside]))
                place = np.concatenate((found[i][1], alive[inside] + at))
                first = best(score, columns.id[place], most)
                found[i] = score[first], place[first]
    return found


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors dealt into the same cells, ready to be cogrouped."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # More groups cost copies of the anchors only, more slices copies of the rows.
    groups = max(-(-n_rows // ROWS_HELD), min(4 * cores, -(-n_rows // ROWS_LEAST)))
    slices = -(-n_anchors // ANCHORS_HELD)
    cells = groups * slices
    left = rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = anchors.select(*[F.col(c).alias(f"own_{c}") for c in anchors.columns]).withColumn("s", F.pmod(F.xxhash64("own_row"), F.lit(slices)).cast("int"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return [df.withColumn("cell", F.col("g") * F.lit(slices) + F.col("s")).drop("g", "s").repartition(cells, "cell").groupBy("cell")
            for df in (left, right)]


def windows_of(scores: list[int], shares: tuple[int, int]) -> tuple[list[int], list[int]]:
    """The least and the greatest whole scores within so many percent of each score."""
    return [-(-p * shares[0] // 100) for p in scores], [p * shares[1] // 100 for p in scores]


def scanned(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, width: int, most: int,
            shares: tuple[int, int] | None = None) -> DataFrame:
    """(anchor, window, other, score, place) of the best rows for anchors (row, id, label, vector, scores).

    Without ``shares`` rows of the anchor's label, in one window of all scores; else rows of other labels, in
    a window for each of ``scores``.
    """
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            columns = Columns(left, width)
            vectors = matrix(right.column("own_vector"), width)
            names, labels, asked = (right.column(c).to_pylist() for c in ("own_row", "own_label", "own_scores"))
            for row, label, vector, scores in zip(names, labels, vectors, asked, strict=True):
                low, high = ([-(1 << 62)], [1 << 62]) if shares is None else windows_of(scores, shares)
                start, stop = np.searchsorted(columns.label, [label, label + 1])

                def wanted(at: int, to: int) -> np.ndarray:
                    if shares is None:
                        places = np.arange(max(at, start), max(at, start, min(to, stop)))
                        return places[columns.row[places] != row]
                    return np.concatenate((np.arange(at, min(to, max(at, start))), np.arange(max(at, min(to, stop)), to)))

                for window, (score, place) in enumerate(scan(columns, vector, wanted, low, high, most)):
                    out[0] += [row] * len(score)
                    out[1] += [window] * len(score)
                    out[2] += columns.id[place].tolist()
                    out[3] += score.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "window", "other", "score"])

    left, right = _cells(rows, anchors, n_rows, n_anchors)
    found = left.cogroup(right).applyInArrow(cell, "anchor bigint, window bigint, other bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95),
         id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of the anchors.

    Scores are integer inner products of the scaled vectors.  The positives of an anchor are its
    best other rows of its label; for each, the negatives are the best rows of other labels whose score
    is ``shares[0]`` to ``shares[1]`` percent of the positive's.  Ties go by smaller id.  Rows with a null
    label, a null vector or a component that is null or not finite take no part.  Null ids count as
    the largest one, and come out as null; they are anchors if ``is_anchor``, a condition on ``id``, holds for null.  Rows of
    one id are rows of their own, repeated ones too.  Short or empty vectors end in zeros; scaled components beyond
    2**24 count as that.  Other columns are not looked
    at, whatever their names.  Without an anchor, as in an empty table, there is no row.
    """
    rows = taking_part(rows, id_col, vector_col, F.col("`label`") if label is None else label)
    chosen = F.coalesce(is_anchor, F.lit(False))
    known = rows.withColumn("chosen", chosen).withColumn("id", F.coalesce("id", F.lit(LAST_ID)))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(chosen).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    counts = (max(sizes["rows"], 1), max(sizes["anchors"], 1), sizes["width"] or 0)
    known, anchors = known.drop("chosen"), known.where("chosen").drop("chosen")
    asked = anchors.withColumn("scores", F.array().cast("array<bigint>"))
    pairs = written(scanned(known, asked, *counts, positives).select(
        "anchor", F.col("other").alias("positive"), F.col("score").alias("positive_score")))
    # Positives of one score share a window.
    windows = pairs.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked = anchors.join(windows.withColumnRenamed("anchor", "row"), "row")
    found = scanned(known, asked, *counts, negatives, shares).join(windows, "anchor")
    found = found.withColumn("positive_score", F.get("scores", F.col("window").cast("int")))
    named = found.join(pairs, ["anchor", "positive_score"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select(
        F.nullif("anchor_id", F.lit(LAST_ID)).alias("anchor_id"), F.nullif("positive", F.lit(LAST_ID)).alias("positive_id"),
        F.col("place").cast("int").alias("rank"), F.nullif("other", F.lit(LAST_ID)).alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
