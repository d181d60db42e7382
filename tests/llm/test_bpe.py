import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from clinisieve.llm import bpe, queries
from tests.llm.cases import awkward, frame

PATH = P.path(queries.BPE_FILE)


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_on_random_texts(both):
    own, theirs = both
    rnd = random.Random(3)
    vocab = [t.decode("utf-8", "ignore") for t in own.ranks]
    texts = ["".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([*range(32, 127), *range(0xA0, 0x250), 0x4E00 + rnd.randrange(9000)])) for _ in range(40)) for _ in range(500)]
    texts += ["".join(rnd.choice("aeinst") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    texts += ["a" * 5000, " " * 3000 + "x", "\n" * 999, "ab" * 2000, "é" * 1000, "<|endoftext|>"]
    for text in texts:
        ids = list(own.encode(text))
        assert ids == theirs.encode_ordinary(text)
        assert bpe.decoded(ids, own.bytes_of) == text.encode()


def test_every_character(both):
    own, theirs = both
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4000):
        text = "".join(f"a {c}1" for c in chars[at:at + 4000])
        assert list(own.encode(text)) == theirs.encode_ordinary(text)


def test_tokens_that_merges_cannot_make():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bcd": 257, b"abab": 258}
    own = bpe.ByteBPE(ranks, r"[a-z]+|[^a-z]+")
    theirs = tiktoken.Encoding("own", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "xabc", "abcab", "bcd", "abcdabc", "ababab", "xababab"):
        assert list(own.encode(text)) == theirs.encode_ordinary(text)


def test_long_texts_piece_by_piece(both, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    monkeypatch.setattr(bpe, "_AT_ONCE", 7)
    own, theirs = both
    rnd = random.Random(8)
    for n in (0, 49, 50, 51, 3000):
        text = "".join(rnd.choice(["the ", "Straße", "\n", "  ", "数学", "42", "'s", "😀", "x"]) for _ in range(n))
        ids = list(own.encode(text))
        assert ids == theirs.encode_ordinary(text)
        assert bpe.decoded(ids, own.bytes_of) == text.encode()


def test_memos_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    own = bpe.ByteBPE({t: r for t, r in both[0].ranks.items() if r < 3000}, P.PATTERN)
    text = " ".join(f"word{i} other{i * 7}" for i in range(200))
    list(own.encode(text))
    assert len(own.known) <= 5 and len(own.fitting) <= 5


def test_frequent_pieces_stay_in_a_full_memo(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 64)
    own = bpe.ByteBPE({t: r for t, r in both[0].ranks.items() if r < 3000}, P.PATTERN)
    encoded, encode_piece = [], own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: encoded.append(piece) or encode_piece(piece))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    text = "".join(f" frequentword rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    assert list(own.encode(text)) == theirs.encode_ordinary(text)
    assert encoded.count(b" frequentword") == 1 and len(encoded) == 501
    for memo in (own.known, own.fitting):
        assert len(memo) <= 64 and len(memo.older) <= 64


def test_neighbours_that_fit_are_those_that_merges_leave(both):
    own, _ = both
    rnd = random.Random(5)
    short = [r for t, r in own.ranks.items() if len(t) == 1 or len(t) <= 4 and own.left[r] >= 0]
    pairs = [(rnd.choice(short), rnd.choice(short)) for _ in range(5000)] + [(r, r) for r in short[:2000]]
    assert len({own.fit(x, y) for x, y in pairs}) == 2
    for x, y in pairs:
        parts = [own.bytes_of[x], own.bytes_of[y]]
        assert own.fit(x, y) == (own._merge(b"".join(parts)) == parts)


def test_vocabulary_of_bytes_only():
    own = bpe.ByteBPE({bytes([b]): 255 - b for b in range(256)}, r"\S+|\s+")
    assert list(own.encode("añ b")) == [255 - b for b in "añ b".encode()]


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, ".")
    with pytest.raises(ValueError):  # merges of falling rank
        bpe.ByteBPE({bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}, ".")


def test_round_trip_of_awkward_rows(spark, both):
    rows = awkward()
    docs = bpe.tokenized(frame(spark, rows), "text", PATH, P.PATTERN)
    got = docs.select("*", bpe.decode(bpe.F.col("ids"), PATH).alias("back")).collect()
    assert sorted(map(repr, (tuple(r)[:9] for r in got))) == sorted(map(repr, rows))
    for r in got:
        assert r.ids == both[1].encode_ordinary(r.text or "") and bytes(r.back) == bytes(r.decoded) == (r.text or "").encode()
    assert bpe.tokenized(frame(spark, []), "text", PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark, both):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = both[1].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_columns_of_the_same_names_are_replaced(spark, both):
    docs = spark.createDataFrame([(1, "one two", "x", "y")], "doc_id bigint, text string, ids string, Decoded string")
    got = bpe.tokenized(docs, "text", PATH, P.PATTERN)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and got.first().ids == both[1].encode_ordinary("one two")


def test_rows_without_text_among_others(spark, both):
    for texts in ([None, ""], [None, "ein Wort", "", "é\n", None]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
        got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.tokenized(docs, "text", PATH, P.PATTERN).collect()}
        assert got == {i: (both[1].encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
