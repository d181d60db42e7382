import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from clinisieve.llm import queries, sketch
from tests.llm.cases import awkward, frame


def tie(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (value >> 63 << 64)


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1] or ""), r[1] or ""))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def edited(text, following):
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


def test_edits_of_awkward_rows(spark):
    rows = awkward()
    for partitions in (1, 3):
        docs = frame(spark, rows).repartition(partitions)
        got = sketch.edited_fingerprints(docs, id_col="doc_id").collect()
        want = sorted(((r[0] or -1, len(r[1] or ""), edited(r[1] or "", n[1] or "")) for r, n in plain_next(rows)))
        assert sorted((r.doc_id or -1, r.n_chars, r.edited) for r in got) == want


def test_next_crosses_ranges(spark):
    rows = [(i * 3, f"text {i} " * (i % 5), "en", "a", 1, "", 0, "", 0) for i in range(500)]
    got = sketch.with_next(frame(spark, rows).repartition(5), "doc_id", ["text"], per_range=10).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == 500 and all(r.next_text == texts[(r.doc_id + 3) % 1500] for r in got)
    one = sketch.with_next(frame(spark, rows[:1]), "doc_id", ["text"]).collect()
    assert [(r.doc_id, r.next_text) for r in one] == [(0, rows[0][1])]
    assert sketch.with_next(frame(spark, []), "doc_id", ["text"]).count() == 0


def test_next_of_ids_beyond_the_doubles(spark):
    rnd = random.Random(11)
    for ids in ([rnd.randrange(-2**63, 2**63 - 1) for _ in range(500)], [2**60 + i for i in range(500)], [2**62 + i for i in range(250)] + [-2**62 - i for i in range(250)]):
        rows = [(i, f"text {i}", "en", "a", 1, "", 0, "", 0) for i in ids]
        got = sketch.with_next(frame(spark, rows).repartition(5), "doc_id", ["text"], per_range=10).collect()
        order = sorted(ids)
        following = dict(zip(order, [*order[1:], order[0]], strict=True))
        assert sorted(r.doc_id for r in got) == order
        assert all(r.next_text == f"text {following[r.doc_id]}" for r in got)


def test_next_of_many_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([None, None, 7, 7, i, -i]), f"text {i % 1500}", "en", "a", 1, "", 0, "", 0) for i in range(2000)]
    got = sketch.with_next(frame(spark, rows).repartition(5), "doc_id", ["text"], per_range=10).collect()
    order = sorted(rows, key=lambda r: (2**63 - 1 if r[0] is None else r[0], tie(r[1]), r[1]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want


def test_a_hot_id_is_many_ranges(spark):
    docs = frame(spark, [(None if i % 3 else i, f"text {i}", "en", "a", 1, "", 0, "", 0) for i in range(3000)])
    place, tie = F.coalesce("doc_id", F.lit(sketch.LAST_ID)), F.xxhash64("text")
    bounds = sketch._bounds(docs.select(place.alias("place")), 30)
    sizes = docs.groupBy(sketch._range_of(place, tie, bounds).alias("range")).count().collect()
    assert len(sizes) > 25 and max(r["count"] for r in sizes) < 300


def shingles(text, width=5):
    words = text.split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_estimates_are_near_the_truth(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for size in (40, 2000):
            a = [rnd.choice(vocab) for _ in range(size)]
            cut = int(size * share)
            texts.append((" ".join(a), " ".join(a[:cut] + [rnd.choice(vocab) for _ in range(size - cut)])))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i int, a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, F.col("a"), "fa"), F.col("b"), "fb")
    for r in df.select("a", "b", sketch.resemblance(F.col("fa"), F.col("fb")).alias("r"), sketch.containment(F.col("fa"), F.col("fb")).alias("c"),
                       sketch.distinct_shingles(F.col("fa")).alias("n"), "fa").collect():
        a, b = shingles(r.a), shingles(r.b)
        assert r.fa == sorted(set(r.fa)) and len(r.fa) == min(128, len(a))
        assert abs(r.r - len(a & b) / len(a | b)) < 0.15
        assert abs(r.c - len(a & b) / len(a)) < 0.25
        assert abs(r.n / len(a) - 1) < 0.3


def test_parts_merge_into_the_whole(spark):
    rnd = random.Random(6)
    words = [f"v{rnd.randrange(900)}" for _ in range(3000)]
    parts = [(1, " ".join(words[i:i + 104])) for i in range(0, 2996, 100)] + [(2, None), (None, "a b c d e f")]
    pieces = sketch.with_sketch(spark.createDataFrame(parts, "k int, text string"), F.col("text"), "s")
    whole = sketch.with_sketch(spark.createDataFrame([(" ".join(words),)], "text string"), F.col("text"), "s").first().s
    merged = {r.k: r.s for r in sketch.merge_sketches(pieces, ["k"], "s").collect()}
    assert merged[1] == whole and merged[2] == [] and len(merged[None]) == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {r[0]: hashlib.sha256(edited(r[1] or "", n[1] or "").encode()).hexdigest() for r, n in plain_next(docs)}
    got = queries.op3_document_fingerprints(spark, sf).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.1 > sum(r.near_next for r in long) / len(long)
    by_text = {}
    texts = dict(docs)
    assert all(by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint for r in got)


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 5)], "doc_id bigint, text string, _words string, Sketch int")
    got = sketch.with_sketch(docs, F.col("text"), "sketch")
    assert got.columns == ["doc_id", "text", "_words", "sketch"] and len(got.first().sketch) == 2
