import random

import pytest

from clinisieve.llm import doubling, repeats
from tests.llm.cases import awkward, frame
from tests.llm.test_repeats import plain, planted, spans


def check(spark, rows, length=50, partitions=3):
    got = doubling.without_repeats(frame(spark, rows).repartition(partitions), length).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3], x[2])
    have = sorted(((r.doc_id, r.n_bytes, list(zip(r.starts, r.stops)), bytes(r.kept)) for r in got), key=key)
    want = sorted(((i, n, spans(g), k) for i, n, g, k in plain(rows, length)), key=key)
    assert have == want
    return sum(len(removed) for _, _, removed, _ in want)


def test_awkward_rows(spark):
    check(spark, awkward())


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 16), (4, 17), (5, 32), (6, 100), (7, 257)])
def test_planted_passages(spark, seed, length):
    rows = planted(seed)
    check(spark, rows, length, seed)


def test_texts_longer_than_a_chunk_and_small_batches(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(70_000))
    rows = [(1, "x" + passage, "en", "a", 1, "", 0, "", 0), (2, passage[100:] + "y" + passage[:300], "en", "a", 1, "", 0, "", 0),
            (3, "z" * 400, "en", "a", 1, "", 0, "", 0), (4, "z" * 300 + "w", "en", "a", 1, "", 0, "", 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(80))
    rows = [(rnd.choice([None, 5, 5, i]), "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 60))) + passage[rnd.randint(0, 20):], "en", "a", 1, "", 0, "", 0)
            for i in range(300)]
    assert check(spark, rows)


def test_same_as_the_sampled_way(spark):
    rows = planted(9, 200)
    one, two = (sorted(map(str, f(frame(spark, rows)).collect())) for f in (doubling.without_repeats, repeats.without_repeats))
    assert one == two


def test_empty_table_and_short_strings(spark):
    assert doubling.without_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="16 bytes"):
        doubling.without_repeats(frame(spark, []), 15)
