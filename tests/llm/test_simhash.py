import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import re
import xxhash

from clinisieve.llm import simhash
from clinisieve.llm.components import components
from tests.llm.cases import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize("piece", [1, 5, 64, 1000])
@pytest.mark.parametrize("width", [1, 2, 3, 6])
def test_long_texts_in_pieces(piece, width):
    rnd = random.Random(piece)
    for n in (0, 1, 2, 3, 5, 40, 300):
        text = rnd.choice(["", " ", "\n\n"]) + "".join(rnd.choice(["a", "The", "über", "数学", "B2"]) + rnd.choice([" ", "\t", "  \n "]) for _ in range(n))
        assert simhash.simhash(text.encode(), width, piece) == plain(text, width)


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_groups_of_awkward_rows(spark):
    rows = awkward()
    got = simhash.near_groups(frame(spark, rows)).collect()
    prints = {(r[0], r[1]): plain(r[1]) for r in rows}
    assert Counter((r.doc_id, r.fingerprint % 2**64) for r in got) == Counter((r[0], prints[r[0], r[1]]) for r in rows)
    items = sorted(set(prints.values()))
    root = roots(items, [(a, b) for a in items for b in items if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert all(r.component_id == least.get(root[r.fingerprint % 2**64]) for r in got)


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_what_is_near_and_nothing_else(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for centre in centres:  # dense balls and chains
        at = centre
        for _ in range(40):
            for _ in range(rnd.randint(0, 4)):
                at ^= 1 << rnd.randrange(64)
            prints.add(at)
            prints.add(centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    items = sorted(prints)
    near = [(a, b) for a in items for b in items if a < b and (a ^ b).bit_count() <= 3]
    classes = spark.createDataFrame([(simhash.signed(x),) for x in items], "fingerprint bigint")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(classes).collect()]
    assert {(min(x), max(x)) for x in links} <= set(near)
    assert roots(items, links) == roots(items, near)
    if block == 4096:
        assert len(links) < 20 * len(items)


def test_discarded_pairs_are_never_near():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(50)]
    bits = np.array(base + [b ^ (1 << rnd.randrange(64)) for b in base], np.uint64)
    table = np.bitwise_count(bits[:, None] ^ simhash.pivots()).astype(np.int8)
    gap = np.abs(table[:50] - table[50:]).max(axis=1)
    assert (gap <= 1).all()


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    links = spark.createDataFrame(chain + star + star + [(5, 5), (7777, 7777)], "a bigint, b bigint")
    got = {(r.node, r.root) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 1000) for i in range(1000, 1100)}


def test_empty_table(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    assert simhash.one_per_group(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = awkward()
    docs = frame(spark, rows)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_groups(docs).select("component", "component_id").distinct().collect()
    got = [r.doc_id for r in kept.collect()]
    assert Counter(got) == Counter(g.component_id for g in groups)
    assert Counter(map(tuple, kept.collect())) <= Counter(rows)


def test_sorted_runs_survive_batch_borders():
    from clinisieve.llm.common import runs_of
    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(range(a, b))], ["k", "v"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 8))]
    runs = [c[0].tolist() for c in runs_of(iter(batches), 1)]
    assert sum(runs, []) == keys and all(set(a).isdisjoint(b) for a, b in zip(runs, runs[1:]))


def test_many_rows_without_id(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(40)) for _ in range(60)]
    rows = [(None, t, "en", "a", 1, "", 0, "", 0) for t in texts] * 2
    got = [r.text for r in simhash.one_per_group(frame(spark, rows)).collect()]
    prints = {t: plain(t) for t in texts}
    items = sorted(set(prints.values()))
    root = roots(items, [(a, b) for a in items for b in items if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for t, p in prints.items():
        least[root[p]] = min(t, least.get(root[p], t))
    assert sorted(got) == sorted(least.values())
