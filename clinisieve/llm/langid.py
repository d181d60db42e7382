"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier tells the languages with a
one from those with a zero: a naive Bayes over hashed byte n-grams whose two sides are the even
mixtures of their languages, so that a language with most of the text does not own a side.  Counting
n-grams per language is one distributed pass with sums per task; what reaches the driver is one weight per
hashed n-gram and bit, whatever the size of the corpus.  A text is given the language whose
codeword loses least: each bit's margin goes through the logistic loss, so that sure bits weigh
more.  A small gap to the second best marks the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.llm.common import slices
from clinisieve.sources.scratch import written

UNDETERMINED = "und"
#: Hashed n-grams; three lengths share them.
BUCKETS = 1 << 16
LENGTHS = (2, 3, 4)
SMOOTHING = 0.5
AMBIGUOUS = 0.02
#: Languages whose counts a task holds at once; a further one flushes them.
HELD = 64
_PART = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte n-grams of a folded text, part by part."""
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(data), _PART):
        part = data[at:at + _PART + max(LENGTHS) - 1]
        for n in LENGTHS:
            size = min(len(part) - n + 1, _PART)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            for j in range(n):
                code = code * np.uint32(257) + part[j:j + size]
            yield (code * np.uint32(2654435761)) >> np.uint32(16)


def folded(text: str) -> bytes:
    """Lower case in all scripts; ASCII characters other than letters become blanks, runs of them one."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int32)), pa.array(counts[found])],
                                             ["lang", "bucket", "n"])
        held.clear()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            if name not in held:
                if len(held) >= HELD:
                    yield from flush()
                held[name] = np.zeros(BUCKETS, np.int64)
            for codes in ngrams(folded(text.as_py())):
                held[name] += np.bincount(codes, minlength=BUCKETS)
    yield from flush()


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A matrix of +1 and -1 with a row for each of ``n`` languages.

    Up to five languages take every split of them into two sides; more take random splits, ten for
    each doubling, the best of many draws by the least distance of two rows.
    """
    if n <= 5:
        splits = [[1 if i == n - 1 or s >> i & 1 else -1 for i in range(n)] for s in range(2 ** max(0, n - 1) - 1)]
        return np.array(splits, np.int8).T.reshape(n, len(splits))
    rng = np.random.default_rng(seed)
    bits = 10 * math.ceil(math.log2(n))
    best, most = None, -1
    for _ in range(200):
        draw = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        flat = np.abs(draw.sum(axis=0)) == n
        draw[0, flat] *= -1
        near = max(int((draw[i] * draw[i + 1:]).sum(axis=1).max(initial=-bits)) for i in range(n - 1))
        if bits - near > most:
            best, most = draw, bits - near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        total, n = np.zeros(self.code.shape[1]), 0
        for codes in ngrams(folded(text)):
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1), n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how clearly it wins, 0 to 1."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        margin, n = self.margins(text)
        margin *= min(math.sqrt(n), 30.0)
        loss = np.logaddexp(0.0, -self.code * margin).sum(axis=1)
        first, second = np.partition(loss, 1)[:2]
        return self.languages[int(loss.argmin())], float((second - first) / (second + first)) if second + first > 0 else 0.0


def train(labelled: DataFrame, seed: int = 0) -> Model:
    """Learn from all rows of (lang, text); rows in which either is null teach nothing.

    The driver gets the names of the languages with their totals, and ``BUCKETS`` rows of weights.
    """
    clean = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = written(clean.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages), seed)
    bits = code.shape[1] if languages else 0
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, bits), np.float32))
    spread = np.array([totals[x] + SMOOTHING * BUCKETS for x in languages])
    spark = labelled.sparkSession
    sides = spark.createDataFrame([(x, float(spread[i]), [int(b > 0) for b in code[i]]) for i, x in enumerate(languages)],
                                  "lang string, spread double, ones array<int>")
    share = F.col("n") / F.col("spread")
    summed = counts.join(sides, "lang").groupBy("bucket").agg(
        F.sum(share).alias("all"), *[F.sum(share * F.col("ones")[b]).alias(f"b{b}") for b in range(bits)])
    everything, ones = np.zeros(BUCKETS), np.zeros((BUCKETS, bits))
    for r in summed.collect():
        everything[r.bucket] = r["all"]
        ones[r.bucket] = r[2:]
    base = SMOOTHING / spread
    positive = (code > 0).astype(float)
    on = (ones + base @ positive) / positive.sum(axis=0)
    off = (everything[:, None] - ones + base @ (1 - positive)) / (1 - positive).sum(axis=0)
    return Model(languages, code, np.log(on / np.maximum(off, 1e-300)).astype(np.float32))


def predictions(df: DataFrame, model: Model, text_col: str = "text", lang_into: str = "lang_pred", score_into: str = "score") -> DataFrame:
    """``df`` with the predicted language and a score; only the text is looked at.

    Texts that are null or without a letter, and all texts if no language was learned, are ``und``
    with score 0.  Columns that ``df`` has by the two names are replaced.  Rows alike are each predicted, alike,
    and an empty table gives an empty table.
    """
    df = df.drop(lang_into, score_into)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, at)):
            found = [model.predict(t.as_py()) for t in part.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*part.schema.names, lang_into, score_into])
    schema = df.select("*", F.lit("").alias(lang_into), F.lit(0.0).alias(score_into)).schema
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning, by the checksum of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_on(docs: DataFrame) -> Model:
    """Learn from the documents that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
