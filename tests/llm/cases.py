"""Awkward documents, and plain versions of what operators share."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, size int, fingerprint string, component_id int"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, "y", 2)


def awkward():
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, other scripts."""
    rnd = random.Random(7)
    words = "the of river stone über Straße ça l'été señor 数学 данные 😀 a1 B2".split()
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(30)]
    rows = [row(10 * i, t, source=rnd.choice(["a", "b", "Z", None])) for i, t in enumerate(prose)]
    rows += [row(3, None), row(5, ""), row(7, " \n\t "), row(None, "the null id"), row(None, None), row(11, long, "de", "b"),
             row(12, prose[0]), row(12, prose[0]), row(12, prose[1]), row(13, prose[2] + " tail"), row(14, "A\x00B\x1c c\x85d e"),
             (15, None, None, None, None, None, None, None, None), row(-4, "x"), row(16, "one"), row(17, "one two"), row(18, "word " * 300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
