import random
import re
from collections import Counter

import pytest

from clinisieve.llm import licenses, queries
from clinisieve.llm.common import pieces
from tests.llm.cases import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = words_of(text)
    hits = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), sorted({x for _, x in hits})


def plain_spans(text, k=licenses.K, templates=licenses.TEMPLATES):
    """Spans by comparing every run with every place of every template."""
    words, out = words_of(text), []
    for label, template in templates:
        t = words_of(template)
        runs = {}
        for p in range(len(t) - k + 1):
            runs.setdefault(tuple(t[p:p + k]), []).append(p)
        hits = sorted((i - p, i, p) for i in range(len(words) - k + 1) for p in runs.get(tuple(words[i:i + k]), ()))
        groups = []
        for hit in hits:
            if not groups or hit[0] - groups[-1][-1][0] > licenses.DRIFT:
                groups.append([])
            groups[-1].append(hit)
        for g in groups:
            found = {p + j for _, _, p in g for j in range(k)}
            there = {i + j for _, i, _ in g for j in range(k)}
            if len(found) >= min(-(-len(t) * 4 // 5), licenses.ENOUGH) and len(there) / (max(there) - min(there) + 1) >= licenses.DENSITY:
                out.append((there, (label, min(there), max(there), round(len(found) / len(t), 9))))
    largest, own = {}, {}
    for there, (label, _, _, coverage) in out:
        for w in there:
            largest[w] = max(largest.get(w, (0, 0)), (len(there), coverage))
            own[w, label] = max(own.get((w, label), (0, 0)), (len(there), coverage))
    return sorted({span for there, span in out if any(own[w, span[0]] == largest[w] for w in there)})


def rows_with_licenses():
    rnd = random.Random(11)
    vocab = "the of license mit apache general public work under software version 2 0 é".split()
    rows = awkward()
    for i in range(60):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        _, template = rnd.choice(licenses.TEMPLATES)
        words = template.split()
        for _ in range(rnd.choice([0, 0, 1, 3])):  # words put in, left out or changed
            at = rnd.randrange(len(words))
            words[at:at + 1] = rnd.choice([[], ["extra", words[at]], ["changed"]])
        parts.insert(rnd.randint(0, 3), " ".join(words))
        rows.append((100_000 + i, "\n".join(parts), "en", "a", 1, "", 0, "", 0))
    return rows


def test_against_a_plain_version(spark):
    rows = rows_with_licenses()
    got = licenses.scan(frame(spark, rows).repartition(3)).collect()
    have = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels),
                    tuple((s.label, s.first_word, s.last_word, round(s.coverage, 9)) for s in r.spans), tuple(r.labels), round(r.score, 9)) for r in got)
    want = Counter()
    for r in rows:
        base, spans = plain_base(r[1]), plain_spans(r[1])
        want[(r[0], *base[:4], tuple(base[4]), tuple(spans), tuple(sorted({*base[4], *(s[0] for s in spans)})), max((s[3] for s in spans), default=0.0))] += 1
    assert have == want
    assert sum(bool(k[6]) for k in want) > 30


@pytest.mark.parametrize("label,text", licenses.TEMPLATES)
def test_every_template_finds_itself(label, text):
    assert (label, 1.0) in {(s[0], s[3]) for s in plain_spans("before it " + text + " after it")}


@pytest.mark.parametrize("label,text", licenses.TEMPLATES)
def test_a_template_has_its_label_alone(label, text):
    assert {s[0] for s in plain_spans("before it " + text + " after it")} == {label}


NOTICES = [
    ("cc-by", "Photos: CC BY 4.0."), ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 3.0"), ("cc-by-nc", "Text under CC BY-NC 3.0, 2014"),
    ("cc-by-nc-nd", "It is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nd", "under the Creative Commons Attribution-NoDerivs 3.0 Unported License, see below"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007"), ("bsd", "licensed under the BSD 3-Clause License"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
]


def test_short_notices_have_one_label(spark):
    rows = [(i, f"Some words come first. {text} Others follow.", "en", "a", 1, "", 0, "", 0) for i, (_, text) in enumerate(NOTICES)]
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {i: {label} for i, (label, _) in enumerate(NOTICES)}


def test_pieces_change_nothing(spark):
    docs = frame(spark, rows_with_licenses()).repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, str(r))
    assert sorted(licenses.scan(docs, piece=50).collect(), key=key) == sorted(licenses.scan(docs).collect(), key=key)


@pytest.mark.parametrize("room", [1, 7, 40, 1000])
def test_phrases_and_runs_across_pieces(room):
    rnd = random.Random(room)
    text = " ".join(rnd.choice("mit license apache general public é MIT-License".split()) for _ in range(400)).encode()
    whole, reader, runs = licenses.Reader(licenses.Hashes(), 4), licenses.Reader(licenses.Hashes(), 4), []
    _, want = whole.take(licenses.words_of(text))
    for words in map(licenses.words_of, pieces(text, licenses._GAP, room)):
        start, found = reader.take(words)
        assert start == len(runs) or not len(found)
        runs += found.tolist()
    assert runs == want.tolist()
    assert (reader.n_words, reader.n_base, reader.first, reader.last, reader.labels) == (whole.n_words, whole.n_base, whole.first, whole.last, whole.labels)


def whole_license(seed, base=None, changed=0.0):
    rnd = random.Random(seed)
    words = base or [rnd.choice("the of license you may copy work terms under this notice grant right each party".split()) + str(rnd.randrange(40))
                     for _ in range(2000)]
    return [w if rnd.random() >= changed else f"other{rnd.randrange(10**6)}" for w in words]


def test_whole_texts_from_a_folder(spark, tmp_path):
    first = whole_license(1)
    second = whole_license(2, first, 0.05)  # a license that varies another one, as the GNU licenses do
    (tmp_path / "First-1.0.txt").write_text(" ".join(first))
    (tmp_path / "second").write_text("\n".join(second))
    templates = licenses.read_templates(spark, str(tmp_path))
    assert [label for label, _ in templates] == ["first-1.0", "second"]
    rows = [(0, "intro " + " ".join(first) + " end", "en", "a", 1, "", 0, "", 0), (1, " ".join(second), "en", "a", 1, "", 0, "", 0),
            (2, " ".join(whole_license(3, second, 0.01)), "en", "a", 1, "", 0, "", 0), (3, "no license", "en", "a", 1, "", 0, "", 0)]
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan(frame(spark, rows), templates).collect()}
    assert got == {0: {"first-1.0"}, 1: {"second"}, 2: {"second"}, 3: set()}


def test_too_large_a_folder_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("word " * 100)
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 100)
    with pytest.raises(ValueError, match="500 bytes"):
        licenses.read_templates(spark, str(tmp_path))


def test_clean_texts_have_no_labels(spark):
    rnd = random.Random(12)
    vocab = "the of license mit apache general public work under software version 2 0".split()
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(100)), "en", "a", 1, "", 0, "", 0) for i in range(40)]
    assert all(not r.spans for r in licenses.scan(frame(spark, rows)).collect())


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_license_scans(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (*base[:4], ",".join(base[4]))
        assert set(base[4]) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
