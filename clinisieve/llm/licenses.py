"""License scans by diagonal voting.

Every run of k words of every document is hashed, and Spark joins the hashes to the positions of the
templates' runs.  A hit votes for the diagonal (position in the document less position in the
template) of its template; votes are summed per diagonal, diagonals that lie near each other are
merged, as words put in or left out shift the rest, and a merged span is accepted if enough of the
template's words are found and the span is dense with them.  As licenses quote and vary each other, each word
belongs to the largest span over it (with equal words, the best covered), and a span none of whose words belong to its label is dropped.
The templates are a small table of checked size, the only one that is broadcast; a document's runs never
leave the task that read them unless they hit, and long texts are walked in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.llm.common import PIECE, pieces, slices, texts_as_bytes
from clinisieve.llm.wordings import TEMPLATES

K = 4
#: Diagonals at most so far apart belong together.
DRIFT = 6
#: Share of a template's words to be found, and how many suffice however long it is.
COVERAGE = 0.8
ENOUGH = 40
DENSITY = 0.7
MEMO = 200_000
#: Bytes that templates may have together, since their runs are broadcast.
TEMPLATE_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTS = ("id", "n_words", "n_base", "first_word", "last_word", "base_labels")

# Phrases that name a license.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only): runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(_FOLD).split()


class Hashes:
    """Hashes of words, remembered, and of runs of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self.known) >= MEMO:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        known, learn = self.known.get, self.word
        return np.array([known(w) or learn(w) for w in words], np.uint64)


def runs_of(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words with these hashes."""
    if len(values) < k:
        return np.empty(0, np.int64)
    total = np.zeros(len(values) - k + 1, np.uint64)
    for j in range(k):
        total = (total ^ (total >> np.uint64(29))) * _BASE + values[j:j + len(total)]
    return total.view(np.int64)


def places(words: list[bytes], phrase: str) -> list[int]:
    """Where the words of a phrase stand consecutively."""
    joined, wanted = b" " + b" ".join(words) + b" ", f" {phrase} ".encode()
    found, at, counted, number = [], joined.find(wanted), 0, 0
    while at >= 0:
        number += joined.count(b" ", counted, at)
        counted = at
        found.append(number)
        at = joined.find(wanted, at + 1)
    return found


class Reader:
    """Takes in the pieces of a text one after another and sums up the places of phrases."""

    def __init__(self, hashes: Hashes, k: int):
        self.hashes, self.k = hashes, k
        self.n_words = self.n_base = 0
        self.first = self.last = None
        self.labels: set[str] = set()
        self._words: list[bytes] = []
        self._values = np.empty(0, np.uint64)

    def take(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        """The place of the first run that ends in this piece, and the hashes of all that do."""
        for phrase, label in PHRASES:
            reach = phrase.count(" ")
            before = self._words[-reach:] if reach else []
            for at in places(before + words, phrase):
                at += self.n_words - len(before)
                self.n_base += 1
                self.first = at if self.first is None else min(self.first, at)
                self.last = at if self.last is None else max(self.last, at)
                self.labels.add(label)
        start = self.n_words - len(self._values)
        values = np.concatenate([self._values, self.hashes.of(words)])
        self._values = values[max(0, len(values) - self.k + 1):]
        self._words = (self._words + words)[-max(phrase.count(" ") for phrase, _ in PHRASES):]
        self.n_words += len(words)
        return start, runs_of(values, self.k)


def read_templates(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """The texts of a folder of licenses as templates, each labelled by its file's name in lower case, without ``.txt`` or ``.md``.

    Any path that Spark reads will do.  The texts are shipped to all tasks, so a folder of more than
    ``TEMPLATE_BYTES`` is refused.
    """
    name = F.regexp_replace(F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1)), r"\.(txt|md)$", "")
    texts = spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("label"), F.col("value").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"the license texts of {folder} have {size} bytes; {TEMPLATE_BYTES} are the most that are shipped to all tasks")
    return tuple(sorted((r.label, r.text) for r in texts.collect()))


def template_runs(spark: SparkSession, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """(run, template, label, length, place): every run of every template."""
    hashes = Hashes()
    rows = [(int(run), number, label, len(words), place)
            for number, (label, text) in enumerate(templates) for words in [words_of(text.encode())]
            for place, run in enumerate(runs_of(hashes.of(words), k))]
    return spark.createDataFrame(rows, "run bigint, template int, label string, length int, place int")


def _read_words(batches: Iterator[pa.RecordBatch], k: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Rows of (key, id, facts of the text, start, runs), one per piece of a text; the last one alone holds the facts."""
    hashes = Hashes()
    for batch in batches:
        kinds = [pa.int64(), batch.column(1).type, *[pa.int64()] * 4, pa.list_(pa.string()), pa.int64()]

        def packed(rows: list[tuple], kinds: list[pa.DataType] = kinds) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:8], kinds, strict=True)]
            ends = pa.array(np.cumsum([0, *(len(r[8]) for r in rows)]), pa.int32())
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[8] for r in rows]))))
            return pa.RecordBatch.from_arrays(columns, ["key", "id", *_FACTS[1:], "start", "runs"])

        for part in slices(batch, 2):
            rows: list[tuple] = []
            for key, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_as_bytes(part.column(2)), strict=True):
                reader, held = Reader(hashes, k), None
                for words in map(words_of, pieces(text or b"", _GAP, piece)):
                    if held:
                        yield packed([(key, None, None, None, None, None, None, *held)])
                    held = reader.take(words)
                rows.append((key, doc_id, reader.n_words, reader.n_base, reader.first, reader.last, sorted(reader.labels), *held))
            if rows:
                yield packed(rows)


def _covered(starts: str, k: int):
    """The words that the runs at these places cover."""
    return F.array_distinct(F.flatten(F.transform(F.col(starts), lambda p: F.sequence(p, p + (k - 1)))))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K, id_col: str = "doc_id", text_col: str = "text",
         piece: int = PIECE) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    ``n_base`` counts the places of ``PHRASES``, the first and last of which start at ``first_word`` and
    ``last_word`` (words from 0; null without a place).  ``spans`` are the verified matches of templates:
    label, first and last word, and coverage, the share of the template's words found.  A span all of whose words
    are also in larger ones (more words of the text found, or as many and a better coverage) of other labels is none: a longer kind of a license is not also
    the shorter one.  ``labels`` are those of phrases and spans, distinct and
    sorted; ``score`` is the best coverage, 0 without a span.  Null and empty texts have no words.  Texts are taken apart
    in pieces of ``piece`` bytes.  Rows that are
    alike are each scanned.  Other columns are not looked at, whatever their names.  An empty table gives an empty table.
    """
    chosen = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField("key", T.LongType()), T.StructField("id", chosen.schema["id"].dataType),
              *[T.StructField(c, T.LongType()) for c in _FACTS[1:5]], T.StructField("base_labels", T.ArrayType(T.StringType())),
              T.StructField("start", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType()))]
    read = chosen.mapInArrow(lambda b: _read_words(b, k, piece), T.StructType(fields))
    each = read.select("key", F.when(F.col("n_words").isNotNull(), F.struct(*_FACTS)).alias("facts"), "start", F.posexplode_outer("runs").alias("at", "run"))
    # One row of a document goes on in any case and carries its facts; of the others only hits do.
    heads = F.coalesce("at", F.lit(0)) == 0
    hits = each.join(F.broadcast(template_runs(docs.sparkSession, templates, k)), "run", "left").where(
        F.col("template").isNotNull() | (heads & F.col("facts").isNotNull()))
    hits = hits.select("key", F.when(heads, F.col("facts")).alias("facts"), "template", "label", "length", "place",
                       (F.col("start") + F.col("at")).cast("int").alias("at"))
    diagonals = hits.groupBy("key", "template", "label", "length", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.max("facts").alias("facts"), F.collect_set("place").alias("places"), F.collect_set("at").alias("ats"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int")
    numbered = diagonals.withColumn("span", F.sum(F.coalesce(opens, F.lit(0))).over(along))
    merged = numbered.groupBy("key", "template", "label", "length", "span").agg(
        F.max("facts").alias("facts"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    sized = merged.select("key", "facts", "label", "length", F.size(_covered("places", k)).alias("found"), _covered("ats", k).alias("words"))
    first, last = F.array_min("words"), F.array_max("words")
    verified = F.col("label").isNotNull() & (F.col("found") >= F.least(F.ceil(F.col("length") * COVERAGE), F.lit(ENOUGH))) & (
        F.size("words") / (last - first + 1) >= DENSITY)
    spans = sized.select("key", "facts", "label", F.struct(F.size("words"), F.col("found") / F.col("length")).alias("rank"), F.when(verified, F.col("words")).alias("words"), F.struct(
        "label", first.cast("bigint").alias("first_word"), last.cast("bigint").alias("last_word"),
        (F.col("found") / F.col("length")).alias("coverage")).alias("span"))
    # Every word belongs to the labels of the largest spans over it; rows without a verified span have one row without a word.
    by_word = spans.select("key", "facts", "label", "rank", "span", F.posexplode_outer("words").alias("_", "word"))
    by_word = by_word.withColumn("facts", F.when(F.coalesce("_", F.lit(0)) == 0, F.col("facts")))
    belongs = F.max("rank").over(Window.partitionBy("key", "word", "label")) == F.max("rank").over(Window.partitionBy("key", "word"))
    owned = by_word.withColumn("own", F.col("word").isNotNull() & belongs)
    rows = owned.groupBy("key").agg(F.max("facts").alias("facts"), F.array_sort(F.collect_set(F.when(F.col("own"), F.col("span")))).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("facts.base_labels", "spans.label")))
    best = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return rows.select(F.col("facts.id").alias(id_col), *[f"facts.{c}" for c in _FACTS[1:]], "spans", labels.alias("labels"), best.alias("score"))
