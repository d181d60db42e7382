import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clinisieve.llm import manifest
from tests.llm.cases import SCHEMA, awkward, frame, row


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(digests, fanout):
    """Levels of one tree, from the leaves to a single node."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, at, fanout):
    for nodes in levels[:-1]:
        first = at - at % fanout
        yield nodes[first:at], nodes[at + 1:first + fanout]
        at //= fanout


def plain(rows, fanout=2):
    """(id, leaf, subroot, root, proof, folded) of every row, in a list."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        bad = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = [leaf((doc_id, source, lang, n, text)) for n in (n_chars, n_chars + 1 if bad else n_chars)]
        groups[lang].append((doc_id is None, doc_id or 0, own[0], doc_id, own[1]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([m[2] for m in sorted(groups[x])], fanout) for x in langs}
    top = grow([trees[x][-1][0] for x in langs], fanout) if langs else []
    out = []
    for n, x in enumerate(langs):
        for i, (_, _, digest, doc_id, changed) in enumerate(sorted(groups[x])):
            path = [*climb(trees[x], i, fanout), *climb(top, n, fanout)]
            at = changed
            for left, right in path:
                at = sha(*left, at, *right)
            out.append((doc_id, digest, trees[x][-1][0], top[-1][0], sha(*[s for left, right in path for s in left + right]), at))
    return out


def run(df, fanout=2):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.manifest(df, tampered={"n_chars": F.col("n_chars") + F.when(hit, 1).otherwise(0)}, fanout=fanout)
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")),
                         manifest.folded(F.col("tampered_leaf"), F.col("path")))
    return [tuple(r) for r in found.collect()]


def key(r):
    return r[0] is None, r[0] or 0, *r[1:]


@pytest.mark.parametrize("fanout", [2, 3])
def test_awkward_documents_equal_the_plain_version(spark, fanout, monkeypatch):
    monkeypatch.setattr(manifest, "STEPS", 2)  # several rounds already on small groups
    rows = awkward()
    found = run(frame(spark, rows).repartition(5), fanout)
    want = plain(rows, fanout)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert {r[5] == r[3] for r in found} == {True, False}


def test_group_sizes_around_powers_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(manifest, "STEPS", 3)
    rows = [row(i, f"text {i}", lang) for n, lang in ((1, "a"), (2, "b"), (7, "é"), (8, None), (9, "d"), (300, "e")) for i in range(1000 * n, 1000 * n + n)]
    assert sorted(run(frame(spark, rows).repartition(7)), key=key) == sorted(plain(rows), key=key)


def test_repeated_rows_and_null_ids_have_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(manifest, "STEPS", 3)
    rows = [row(5, "same")] * 200 + [row(None, f"t{i % 3}") for i in range(200)]
    assert sorted(run(frame(spark, rows).repartition(6)), key=key) == sorted(plain(rows), key=key)


def test_one_row_and_no_row(spark):
    one = [row(7, "x")]
    assert run(frame(spark, one)) == plain(one)
    assert run(spark.createDataFrame([], SCHEMA)) == []
