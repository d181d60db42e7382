import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinisieve.llm import langid, queries
from tests.llm.cases import awkward, frame

SYLLABLES = {"aa": "tha ing ent of er", "bb": "eau ou tion é le", "cc": "sch ung ein ü der", "dd": "ción os ado ñ que", "ee": "ski owa ź cz ł", "ff": "да не ка ст ой", "gg": "ni wa の は た"}


def prose(lang, rnd, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def labelled(langs, n, seed=1):
    rnd = random.Random(seed)
    return [(i, prose(langs[i % len(langs)], rnd, rnd.randint(3, 40)), langs[i % len(langs)], "s", 1, "", 0, "", 0) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 40])
def test_codewords_differ_in_many_bits(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    apart = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(apart, default=1) >= (1 if n < 3 else 2 if n == 3 else 3)
    if n > 1:
        assert (np.abs(code.sum(axis=0)) < n).all()


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc", "dd"], list(SYLLABLES)])
def test_held_out_accuracy(spark, langs):
    docs = frame(spark, labelled(langs, 400))
    model = langid.train_on(docs)
    got = langid.predictions(docs.select("doc_id", "lang", "text"), model).withColumn("held_out", langid.held_out(F.col("doc_id"))).collect()
    test = [r for r in got if r.held_out]
    assert 60 < len(test) < 140
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_weights_against_a_plain_version(spark):
    rows = labelled(["aa", "bb", "cc"], 60)
    model = langid.train(frame(spark, rows).select("lang", "text"))
    counts = {x: np.zeros(langid.BUCKETS) for x in model.languages}
    for r in rows:
        data = b" " + langid.folded(r[1]) + b" "
        for n in langid.LENGTHS:
            for i in range(len(data) - n + 1):
                code = n
                for b in data[i:i + n]:
                    code = (code * 257 + b) % 2**32
                counts[r[2]][(code * 2654435761 % 2**32) >> 16] += 1
    p = {x: (c + langid.SMOOTHING) / (c.sum() + langid.SMOOTHING * langid.BUCKETS) for x, c in counts.items()}
    for b in range(model.code.shape[1]):
        on = np.mean([p[x] for i, x in enumerate(model.languages) if model.code[i, b] > 0], axis=0)
        off = np.mean([p[x] for i, x in enumerate(model.languages) if model.code[i, b] < 0], axis=0)
        assert np.allclose(model.weights[:, b], np.log(on / off), atol=1e-4)


def test_held_out_rows_teach_nothing(spark):
    rows = labelled(["aa", "bb"], 200)
    poisoned = [(*r[:2], "zz", *r[3:]) if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r for r in rows]
    one, two = langid.train_on(frame(spark, rows)), langid.train_on(frame(spark, poisoned))
    assert one.languages == two.languages == ["aa", "bb"] and np.array_equal(one.weights, two.weights)


def test_awkward_rows_and_few_languages(spark):
    docs = frame(spark, awkward())
    model = langid.train_on(docs)
    got = langid.predictions(docs, model).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
        assert r.lang_pred in ("und", *model.languages)
    none = langid.train(docs.where("false").select("lang", "text"))
    assert {(r.lang_pred, r.score) for r in langid.predictions(docs, none).collect()} == {("und", 0.0)}
    one = langid.train(docs.where("lang = 'en'").select("lang", "text"))
    assert {r.lang_pred for r in langid.predictions(docs, one).collect()} == {"und", "en"}
    assert langid.predictions(docs.where("false"), model).count() == 0


def test_long_texts_in_parts(monkeypatch):
    text = langid.folded(prose("aa", random.Random(3), 500))
    whole = np.sort(np.concatenate(list(langid.ngrams(text))))
    monkeypatch.setattr(langid, "_PART", 100)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.ngrams(text)))))


def test_query(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in test) / len(test) > 0.95
