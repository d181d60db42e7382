import re
from collections import Counter, defaultdict

import pytest

from clinisieve.llm import mixing
from tests.llm.cases import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal the share by weight; give back what sources cannot take, and deal it again, until all can."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, got):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = defaultdict(list)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    for r in got:
        source[r.source_size].append(r)
    wanted = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in wanted.values()})
    by_target = defaultdict(int)
    for r in got:
        by_target[round(r.target, 6)] += r.taken
    for s, t in wanted.items():
        same = [x for x in wanted if round(wanted[x], 6) == round(t, 6)]
        assert by_target[round(t, 6)] == len(same) * int(t + 1e-9), s


def test_awkward_rows(spark):
    rows = awkward()
    check(rows, mixing.mix(frame(spark, rows)).collect())


@pytest.mark.parametrize("counts", [{"a": 50, "b": 3, "c": 1}, {"a": 1, "b": 40, "c": 40, "d": 2, None: 9}, {"x": 5}, {f"s{i}": i + 1 for i in range(9)}])
def test_sources_of_many_sizes(spark, counts):
    rows, n = [], 0
    for s, c in counts.items():
        for i in range(c):
            n += 1
            rows.append((n, "w " * (i % 7 + 1), "en", s, 1, "", 0, "", 0))
    docs = frame(spark, rows)
    check(rows, mixing.mix(docs).collect())


def test_null_ids_are_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_RANGE", 16)
    rows = [(None if i % 4 else i, None if i % 5 == 0 else f"w{i} " * (i % 9), "en", "hot" if i % 3 else None, 1, "", 0, "", 0) for i in range(3000)]
    one = mixing.mix(frame(spark, rows)).collect()
    check(rows, one)
    two = mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    # A source's budget ends within it, so if null ids stood together, they would be taken alike.
    assert len({r.taken for r in one if r.doc_id is None and r.size == 8}) > 1


def test_small_ranges_and_reruns_agree(spark, monkeypatch):
    rows = [(i, "w " * (i % 11), "en", "hot" if i % 3 else "cold", 1, "", 0, "", 0) for i in range(400)]
    one = {tuple(r) for r in mixing.mix(frame(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "PER_RANGE", 16)
    two = {tuple(r) for r in mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert one == two


def test_rows_of_the_mixture_add_up(spark):
    rows = awkward()
    docs = frame(spark, rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.schema.names == docs.schema.names
    out = mixed.collect()
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    words = defaultdict(int)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    for r in out:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
        assert any(r.text == t or (t or "").startswith(r.text) for t in texts[r.doc_id])
        assert r.text is None or r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_empty_table_and_no_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_rows(frame(spark, [])).count() == 0
    blank = frame(spark, [(1, None, None, None, None, None, None, None, None), (2, " ", "en", "a", 1, "", 0, "", 0)])
    assert {(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0, 0.0)}
    with pytest.raises(ValueError):
        mixing.mix(blank, share=3.0)


def test_ranges_of_few_words(spark, monkeypatch):
    rows = awkward()
    whole = sorted(map(repr, mixing.mix(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "WORDS_PER_RANGE", 50)
    assert sorted(map(repr, mixing.mix(frame(spark, rows)).collect())) == whole
