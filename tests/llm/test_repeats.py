import hashlib
import random

import numpy as np
import pytest

from clinisieve.llm import queries, repeats
from tests.llm.cases import awkward, frame


def plain(rows, length=50):
    """(id, removed mask, bytes) per row by looking up every string."""
    first = {}
    data = [(2**63 - 1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for i, t in data:
        for at in range(len(t) - length + 1):
            s = t[at:at + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if first[t[at:at + length]] < i:
                gone[at:at + length] = True
        out.append((None if i == 2**63 - 1 else i, len(t), gone, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def spans(gone):
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def check(spark, rows, partitions=3):
    got = repeats.without_repeats(frame(spark, rows).repartition(partitions)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3], x[2])
    have = sorted(((r.doc_id, r.n_bytes, list(zip(r.starts, r.stops)), bytes(r.kept)) for r in got), key=key)
    want = sorted(((i, n, spans(g), k) for i, n, g, k in plain(rows)), key=key)
    assert have == want


def planted(seed, n=60):
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab ", "abcdefgh ", "the of and üß "])
    def noise(k):
        return "".join(rnd.choice(alphabet) for _ in range(k))
    passages = [noise(rnd.choice([49, 50, 51, 66, 90, 300])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 3) if rnd.random() < 0.3 else 0
            parts += [noise(rnd.randint(0, 40)), p[a:], noise(rnd.randint(0, 5))]
            if rnd.random() < 0.3:
                parts[-2] = p[:len(p) // 2] + rnd.choice("xyz") + p[len(p) // 2:]
        rows.append((rnd.randint(0, 10**6), "".join(parts), "en", "a", 1, "", 0, "", 0))
    rows += [(r[0] + 1, r[1], *r[2:]) for r in rnd.sample(rows, 8)]
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_planted_repeats(spark, seed):
    check(spark, planted(seed))


def test_awkward_rows(spark):
    check(spark, awkward())


def test_periodic_texts_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 8)
    monkeypatch.setattr(repeats, "_STEP", 64)
    rows = [(i, t * k, "en", "a", 1, "", 0, "", 0) for i, (t, k) in enumerate([("a", 70), ("a", 49), ("ab", 40), ("aab", 33), ("a", 200), ("ba", 26)])]
    check(spark, rows)
    check(spark, planted(9))


def test_seeds_of_equal_windows_are_equal():
    rnd = random.Random(4)
    data = np.frombuffer(bytes(rnd.randrange(3) for _ in range(3000)), np.uint8)
    name, around, place = repeats.seeds(data, 50, 16)
    shifted = repeats.seeds(np.concatenate(([7], data, [9])).astype(np.uint8), 50, 16)
    inner = (place > 60) & (place < 2900)
    other = dict(zip((shifted[2] - 1).tolist(), zip(shifted[0].tolist(), shifted[1].tolist())))
    assert all(other[p] == (n, a) for n, a, p in zip(name[inner].tolist(), around[inner].tolist(), place[inner].tolist()))
    assert np.diff(place).max() <= 35 and len(place) < 3000 / 10


def test_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(frame(spark, []), length=20)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, int(g.sum()), len(spans(g)), hashlib.sha256(k).hexdigest()) for i, n, g, k in plain(docs)}
    got = {tuple(r) for r in queries.op5_suffix_array_dedup(spark, sf).collect()}
    assert got == want and sum(x[2] for x in want) > 0


@pytest.mark.parametrize("repeated", [None, 77])
def test_ten_thousand_rows_of_one_id(spark, repeated):
    """Each text takes its own cuts, though thousands share an id and a passage at one of several places."""
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(80))
    row = lambda i, t: (i, t, "en", "a", 1, "", 0, "", 0)
    rows = [row(1, passage)]
    for n in range(10_000):
        filler = "".join(rnd.choice("klmnopqrst") for _ in range(rnd.choice([3, 60, 200])))
        rows.append(row(repeated, filler + passage if n % 2 else passage + filler))
    rows += [row(2, passage[:60] + "zz")] * 3
    check(spark, rows, 5)
