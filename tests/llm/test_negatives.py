import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinisieve.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def plain(rows, every):
    """The contract row by row."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(min(max(256 * float(np.float32(x)), -2.0 ** 24), 2.0 ** 24)) for x in vector]
        kept.append((vec_id, whole, label))
    out, last = [], 2 ** 63 - 1
    for n, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last if i is None else i, own, i) for m, (i, w, own) in enumerate(kept) if m != n]
        for p_score, _, _, p in sorted(s for s in scored if s[2] == label)[:5]:
            fitting = sorted(s for s in scored if s[2] != label and -50 * p_score <= -100 * s[0] <= -95 * p_score)[:3]
            out += [(a, p, k + 1, s[3], -p_score, -s[0]) for k, s in enumerate(fitting)]
    return sorted(out, key=str)


def run(spark, rows, every=5, parts=3):
    found = negatives.mine(frame(spark, rows).repartition(parts), F.col("id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def gaussian(n, seed, width=12, labels=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, .3) for _ in range(width)] for _ in range(labels * 2)]
    return [(i, [c + rnd.gauss(0, .2) for c in centres[rnd.randrange(len(centres))]], rnd.randrange(labels)) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_LEAST", 40)
    monkeypatch.setattr(negatives, "ANCHORS_HELD", 17)
    rows = gaussian(300, 3)
    found = run(spark, rows)
    assert found == plain(rows, 5) and len(found) > 100


@pytest.mark.parametrize("stretch", [3, 16, 1 << 13])
def test_scan_of_several_stretches(monkeypatch, stretch):
    """Bounds and the rows found so far prune nothing that a window wants."""
    monkeypatch.setattr(negatives, "STRETCH", stretch)
    rnd = np.random.default_rng(stretch)
    vectors = rnd.integers(-40, 40, (200, 24)).astype(np.int32)
    vectors[50:90] = vectors[50]
    ids, label = rnd.permutation(200), rnd.integers(0, 4, 200)
    table = pa.table({"row": np.arange(200), "id": ids, "label": label, "vector": list(vectors)})
    columns = negatives.Columns(table, 24)
    for a in range(0, 200, 7):
        scores = (vectors.astype(np.int64) @ vectors[a]).tolist()
        for low, high in (([-(1 << 62)], [1 << 62]), ([0, 2000, -500], [900, 2500, 10_000])):
            found = negatives.scan(columns, vectors[a], np.arange, low, high, 4)
            for (score, place), x, y in zip(found, low, high, strict=True):
                want = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if x <= s <= y)[:4]
                assert [(-s, i) for s, i in zip(score.tolist(), columns.id[place].tolist())] == want


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = gaussian(60, 4, labels=2) + [
        (100, None, 1), (105, [1.0, None], 1), (110, [nan] * 3, 0), (115, [-inf] * 3, 0), (120, [.5] * 12, None), (125, [], 0),
        (130, [.5, .5], 1), (135, [0.0] * 12, 1), (None, [.4] * 12, 0), (None, [.4] * 12, 1), (140, [1e38] * 12, 1), (-5, [.3] * 12, 0),
        (145, [-.25] * 12, 0), (200, [.3] * 12, 0), (200, [.3] * 12, 0), (200, [.31] * 12, 1)]
    assert run(spark, rows) == plain(rows, 5)


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_LEAST", 50)
    rows = gaussian(200, 5, labels=3) + [(1000 + i, [.2] * 12, 1) for i in range(100)] + [(2000 + i, [.15] * 12, 2) for i in range(100)]
    assert run(spark, rows, every=10, parts=9) == plain(rows, 10)


def test_lone_label_and_empty_table(spark):
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []


def test_best_with_ties():
    score, ids = np.array([5] * 100 + [7] + [5] * 100), np.arange(201)[::-1].copy()
    assert ids[negatives.best(score, ids, 3)].tolist() == [100, 0, 1]
