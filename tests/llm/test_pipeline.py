from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from clinisieve.llm import bpe, langid, mixing, pii, queries, simhash
from tests.llm.cases import frame
from tests.llm.test_mixing import WORD, plain_targets
from tests.llm.test_simhash import plain, roots

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returned, as rows, with the documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII pseudonyms", "mixing sources to target weights", "byte-level BPE"]
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])


def test_language_stage_keeps_what_has_a_language(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train_on(docs)
    want = [r for r in stages[0][1] for lang, score in [model.predict(r.text)] if lang != "und" and score >= langid.AMBIGUOUS]
    assert Counter(stages[1][1]) == Counter(want) and len(want) > 0.95 * len(stages[0][1])


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages[1][1], stages[2][1]
    prints = {r.doc_id: plain(r.text) for r in before}
    items = sorted(set(prints.values()))
    root = roots(items, [(a, b) for a in items for b in items if a < b and (a ^ b).bit_count() <= 3])
    least = defaultdict(lambda: 2**63)
    for r in before:
        least[root[prints[r.doc_id]]] = min(least[root[prints[r.doc_id]]], r.doc_id)
    assert Counter(after) == Counter(r for r in before if r.doc_id in set(least.values()))


def test_pii_stage_changes_texts_only(stages):
    before, after = ({r.doc_id: r for r in stages[i][1]} for i in (2, 3))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r.lang, r.source, r.n_chars) == (before[i].lang, before[i].source, len(r.text))
        assert (r.text == before[i].text) or any(c.isdigit() or c == "@" for c in before[i].text)


def test_mixing_stage_meets_the_targets(stages):
    before, after = stages[3][1], stages[4][1]
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    assert {s: int(t + 1e-9) for s, t in plain_targets(size).items()} == dict(taken)


def test_token_stage(stages):
    own = bpe.codec(P.path(queries.BPE_FILE), P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids)) for r in stages[5][1])
    assert got == Counter((r.doc_id, tuple(theirs.encode_ordinary(r.text))) for r in stages[4][1])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in stages[5][1])


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5][0]
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[5][1])


AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without id, words enough", None, "b", 5), (3, "12 34", "en", None, 5), (4, "the same words here", "en", "a", 19),
           (4, "the same words here", "en", "a", 19), (5, "the same words here", "en", "a", None), (6, "le mot " * 5000, "fr", "a", 35000)]


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_stages_take_awkward_documents(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            path = str(tmp_path / str(i))
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert out.count() >= (1 if rows else 0)
    extra = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, _lang_pred double")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, extra, SF).count() >= 0
