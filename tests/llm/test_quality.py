import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import sentencepiece

from clinisieve.llm import quality, queries
from tests.llm.cases import awkward, frame

PATH = P.path(queries.PIECE_FILE)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def plain_measures(text, model):
    words = WORD.findall(text or "")
    pieces = [p for w in words for p in model.encode(w)]
    if not pieces:
        return 0, None, None, None
    share = np.array(list(Counter(pieces).values())) / len(pieces)
    bits = -(share * np.log2(share)).sum()
    return (len(pieces), sum(map(len, words)) / len(pieces), sum(model.is_byte(p) for p in pieces) / len(pieces),
            bits / np.log2(len(pieces)) if len(pieces) > 1 else 0.0)


def texts():
    rnd = random.Random(8)
    out = [r[1] for r in awkward()]
    for _ in range(60):
        words = [rnd.choice("a b cc #1 d|e <x> é 数".split()) for _ in range(rnd.randint(0, 60))]
        out.append("".join(w + rnd.choice([" ", "\n", "\t", "\x0b"]) for w in words))
    return out


@pytest.mark.parametrize("memo", [200_000, 3])
def test_measures_against_a_plain_version(memo, monkeypatch):
    monkeypatch.setattr(quality, "MEMO", memo)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words_of = quality.Vocabulary(PATH)
    for text in texts():
        got = quality.measure(text, words_of)
        assert got[:5] == plain_base(text)
        want = plain_measures(text, model)
        assert got[5] == want[0] and (want[1] is None and got[6:] == (None,) * 3 or np.allclose(got[6:], want[1:]))


def corpus(n=400):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("tha ing ent er on re".split()) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(40, 120))), "en", "a", 1, "", 0, "", 0) for i in range(n)]
    bad = [(n + i, " ".join(rnd.choice(vocab)[:3] + rnd.choice(["ſʃ", "𝔄𝔅", "###"]) for _ in range(60)), "en", "a", 1, "", 0, "", 0) for i in range(10)]
    return rows, bad


def test_bands_reject_strange_texts_and_keep_the_rest(spark):
    good, bad = corpus()
    got = {r.doc_id: r.kept for r in quality.verdicts(frame(spark, good + bad), PATH).collect()}
    assert sum(got[r[0]] for r in good) >= 0.99 * len(good)
    assert not any(got[r[0]] for r in bad)


def test_bands_against_a_plain_version(spark):
    good, bad = corpus()
    rows = good + bad + awkward() + [(9000 + i, r[1], "xx", *r[3:]) for i, r in enumerate(good[:20])]
    got = quality.verdicts(frame(spark, rows), PATH).collect()
    ok = [r for r in got if not r.base_failed]
    lang = {r[0]: r[2] for r in rows}
    cls = lambda r: max(5, int(np.floor(np.log2(r.n_tokens))))

    def band(m, members):
        x = sorted(getattr(r, m) for r in members)
        mid = x[(len(x) + 1) // 2 - 1]
        apart = sorted(abs(v - mid) for v in x)
        return mid, max(apart[(len(x) + 1) // 2 - 1] * 1.4826, quality.FLOORS[m])
    for r in got:
        keep = False
        if not r.base_failed:
            own = [x for x in ok if lang[x.doc_id] == lang[r.doc_id] and cls(x) == cls(r)]
            sized = [x for x in ok if cls(x) == cls(r)]
            members = next(g for g in (own, sized, ok) if len(g) >= quality.MIN_GROUP or g is ok)
            off = {m: (getattr(r, m) - b[0]) / b[1] for m in quality.MEASURES for b in [band(m, members)]}
            reach = 1 + quality.SLACK / np.sqrt(r.n_tokens)
            keep = all(abs(v) <= quality.WIDTH * reach for v in off.values()) and off["chars_per_token"] + off["entropy"] >= -quality.JOINT_WIDTH * reach
        assert r.kept == keep, r


def test_awkward_rows_and_empty_table(spark):
    rows = awkward()
    got = quality.verdicts(frame(spark, rows), PATH).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r[0], plain_base(r[1])[0]) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.verdicts(frame(spark, []), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts_of = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_quality_rules(spark, sf).collect()
    assert len(got) == len(texts_of)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts_of[r.doc_id])


def prose(rnd, vocab, n):
    return " ".join(rnd.choice(vocab) for _ in range(n))


def test_rare_languages_and_sizes_are_held_to_their_own_language(spark):
    rnd = random.Random(10)
    common = ["".join(rnd.choice("tha ing ent er on re".split()) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    rare = ["".join(rnd.choice("qz xk vj wq kz".split()) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    made = []
    for lang, vocab, sizes in (("en", common, [40, 80, 160, 320, 640] * 60), ("qx", rare, [40, 80, 160] * 4), ("en", common, [3000] * 6)):
        made += [(lang, prose(rnd, vocab, n + rnd.randrange(n // 4))) for n in sizes]
    strange = [("en", prose(rnd, common[:20], 2500)), ("en", " ".join(rnd.choice(common) + "ſʃ" for _ in range(3000))),
               ("qx", prose(rnd, "qz xk vj wq kz qzxk vjwq".split(), 120))]
    rows = [(i, text, lang, "a", 1, "", 0, "", 0) for i, (lang, text) in enumerate(made + strange)]
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, rows), PATH).collect()}
    assert not any(got[i].base_failed for i in range(len(rows)))
    assert all(got[i].kept for i, (lang, _) in enumerate(made) if lang == "qx")
    assert all(got[i].kept for i in range(len(made) - 6, len(made)))
    assert not any(got[i].kept for i in range(len(made), len(rows)))


def test_a_group_weighs_more_with_each_text():
    shape = (np.full((quality.SIZES, 3), -25.0), np.full(quality.SIZES, 500.0), 0.9)
    cls, medians = np.array([7, 8]), np.array([[2.0, 0.0, 0.8], [3.0, 0.0, 0.6]])
    found = [quality.middles_of(cls, np.array([400.0, n]), medians, shape)[1, 0] for n in (1, 10, 49, 50, 51, 1000, 10**6)]
    assert found == sorted(found) and found[0] < 2.1 and found[-1] > 2.99 and found[4] - found[2] < 0.05
    alone = quality.middles_of(np.array([7]), np.array([2.0]), medians[:1], shape)
    assert np.allclose(alone[0, :2], medians[0, :2])  # no other language's


SCRIPTS = [(None, "other"), ("", "other"), ("12 !?", "other"), ("plain Ünïcode", "Latin"), ("данные x", "Cyrillic"), ("数学の本", "Hiragana"), ("数学", "Han"),
           ("データ", "Katakana"), ("데이터", "Hangul"), ("ab αβ", "Greek"), ("نص abc طويل", "Arabic"), ("हिन्दी", "Devanagari"), ("A\x00\nбв", "Cyrillic")]


def test_main_script(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCRIPTS)], "i int, text string").select("i", quality.main_script(F.col("text")).alias("s"))
    assert {r.i: r.s for r in got.collect()} == {i: f"script: {s}" for i, (_, s) in enumerate(SCRIPTS)}


def test_texts_without_a_language_are_banded_by_script(spark):
    rnd = random.Random(12)
    latin = ["".join(rnd.choice("tha ing ent er on re".split()) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    cyrillic = ["".join(rnd.choice("ная про ест ово при ть".split()) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    texts = [(s, prose(rnd, v, rnd.randrange(60, 150))) for s, v, n in (("Latin", latin, 200), ("Cyrillic", cyrillic, 70)) for _ in range(n)]
    texts += [("Latin", prose(rnd, ["ſʃtha", "ſʃing"] + [w + "ſʃ" for w in latin[:30]], 100)), ("Cyrillic", prose(rnd, [w + "ѪѬ" for w in cyrillic[:30]], 100))]
    verdicts = []
    for labelled in (True, False):
        rows = [(i, t, f"script: {s}" if labelled else None, "a", 1, "", 0, "", 0) for i, (s, t) in enumerate(texts)]
        verdicts.append({r.doc_id: r.kept for r in quality.verdicts(frame(spark, rows), PATH).collect()})
    assert verdicts[0] == verdicts[1]
    assert sum(verdicts[1].values()) >= len(texts) - 5 and not verdicts[1][len(texts) - 1]
