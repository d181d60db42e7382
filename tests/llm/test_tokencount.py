import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clinisieve.llm import tokencount
from tests.llm.cases import SCHEMA, awkward, frame, row

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ab", "the ing's d", "数学日本語한국어é", "ab=-_", "aA1 ,.!'=-", "\U0003fc3b՘xy \x1c\x85 ", "İΣσς ǅ ẞ'LL'Re", "é ́"]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


def random_texts(seed, n, longest):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(k) for _ in range(rnd.randint(1, longest))) for k in (rnd.choice(KINDS) for _ in range(n))]


def test_random_texts_equal_the_library(counter):
    for text in [*random_texts(1, 1500, 60), "", "<|endoftext|>a<|startoftext|> b <|endoftext|", "A<|EndOfText|>", "'s't'res", "=" * 500, "ab" * 400]:
        assert counter.stretch(text)["count"] == plain(text), text


def test_every_transition_is_kept_small(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 50)  # memos are emptied all the time
    own = tokencount.Counter(PATH)
    for text in random_texts(2, 300, 60):
        assert own.stretch(text)["count"] == plain(text), text


@pytest.mark.parametrize("warm_up", [1, 3, 64])
def test_maps_compose_in_any_order(counter, monkeypatch, warm_up):
    monkeypatch.setattr(tokencount, "STRETCH", 7)
    monkeypatch.setattr(tokencount, "WARM_UP", warm_up)
    rnd = random.Random(warm_up)
    inside = 0
    for text in random_texts(3, 700, 120):
        if rnd.random() < .2:
            text = text[:40] + "<|endoftext|>" + text[40:]
        stretches = list(counter.stretches(text))
        assert "".join(s[0] for s in stretches) == text
        inside += sum(s[1] for s in stretches)
        maps = [counter.stretch(*s) for s in stretches]
        while len(maps) > 1:
            i = rnd.randrange(len(maps) - 1)
            maps[i:i + 2] = [counter.composed(maps[i], maps[i + 1])]
        assert maps[0]["count"] == plain(text), text
    assert inside > 100


def test_awkward_documents(spark):
    rows = awkward()
    df = frame(spark, rows)
    found = tokencount.token_counts(df, "text", PATH)
    assert found.columns == [c for c in df.columns if c != "text"] + ["n_tokens"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found.collect())
    assert got == sorted((r[0] is None, r[0] or 0, plain(r[1])) for r in rows)


def test_long_texts_are_cut_and_counted_whole(spark, monkeypatch):
    rnd = random.Random(9)
    words = "the of river stone über Straße l'été señor 数学 data's 42".split()
    rows = [row(1, " ".join(rnd.choice(words) for _ in range(80_000))), row(2, "x" * 300_000), row(3, "abc" * 100_000 + " tail"),
            row(4, "数学" * 100_000), row(5, "é" * 150_000), row(6, "short"), row(2, "=" * 200_000), row(None, "a1 " * 100_000)]
    found = tokencount.token_counts(frame(spark, rows), "text", PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found.collect()) == sorted((r[0] or 0, plain(r[1])) for r in rows)


def test_empty_table(spark):
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA), "text", PATH).collect() == []
