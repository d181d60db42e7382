"""Quality rules: how well a public vocabulary fits a text.

A text's words are cut into the pieces of a SentencePiece vocabulary, each word by itself.  That
gives characters per token, the share of tokens that are bytes of characters the vocabulary lacks,
and the entropy of the tokens.  What is usual differs by language, and the entropy also by length, so
the bands beyond which a text is rejected come from all documents of its language and size (tokens
by powers of two): median and median deviation, from sketches that merge, wider for texts of few tokens.
The fewer texts a language has of a size, the more its neighbouring sizes count, brought to this size by
the steps from size to size; the fewer it has at all, the more those steps come from all languages.
Only the level of the entropy, which length governs, leans on other languages, and only if a language has a few texts in all.
Text with symbols strewn in falls short of both usual fertility and entropy, so their summed deviation
has a band of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.llm.common import BLANKS, slices
from clinisieve.sources.scratch import written

MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Deviations from the median that a band allows, and how much more a text of few tokens gets.
WIDTH = 6.0
JOINT_WIDTH = 4.5
SLACK = 4.0
#: Least deviation of each measure, so that a language whose texts are all alike keeps a band.
FLOORS = {"chars_per_token": 0.03, "fallback_share": 0.01, "entropy": 0.012}
#: What is known of a language and size from elsewhere counts as much as this many texts of its own, at most.
MIN_GROUP = 50
#: As how many texts of a language the level of the entropy in all languages counts.
LEAN = 5
#: How much less each size further away counts.
DECAY = 0.25
#: More than the powers of two that any text's tokens reach.
SIZES = 64
#: Scripts, as regular expressions name them, by which texts without a language are grouped.
SCRIPTS = ("Arabic", "Armenian", "Bengali", "Cyrillic", "Devanagari", "Ethiopic", "Georgian", "Greek", "Han", "Hangul", "Hebrew",
           "Hiragana", "Katakana", "Khmer", "Latin", "Tamil", "Telugu", "Thai")
MEMO = 200_000
MEMO_LENGTH = 64
MEASURES = ("chars_per_token", "fallback_share", "entropy")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES)


class Vocabulary:
    """A SentencePiece model that remembers the pieces of words it has met."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.numbers: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []

    def pieces_of(self, word: bytes) -> np.ndarray:
        return np.array(self.model.encode(word.decode(), num_threads=1), np.int32)

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """A number for each word, equal for equal words, and the pieces by number."""
        if len(self.numbers) > MEMO:
            self.numbers, self.pieces = {}, []
        known, pieces = self.numbers, self.pieces
        own: dict[bytes, int] = {}
        out = np.empty(len(words), np.int64)
        extra: list[np.ndarray] = []
        for i, word in enumerate(words):
            number = known.get(word)
            if number is None:
                if len(word) <= MEMO_LENGTH and len(known) <= MEMO:
                    number = known[word] = len(pieces)
                    pieces.append(self.pieces_of(word))
                else:  # kept for this text only
                    number = own.get(word)
                    if number is None:
                        number = own[word] = -1 - len(extra)
                        extra.append(self.pieces_of(word))
            out[i] = number
        return out, extra


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def repeated_words(numbers: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first one included."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    spread = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + spread[j:j + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    places = np.flatnonzero(twice)  # by hash; now by the words themselves
    windows = np.lib.stride_tricks.sliding_window_view(numbers, width)[places]
    _, group, sizes = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = places[sizes[group.reshape(-1)] > 1]
    covered = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None, words_of: Vocabulary) -> tuple:
    """The values of ``COLUMNS`` for one text; the last three are null without tokens."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(data.count(s) for s in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    numbers, extra = words_of.numbered(words)
    n_repeat = repeated_words(numbers)
    counted, times = np.unique(numbers, return_counts=True)
    # Negative numbers index the pieces that belong to this text only.
    own = [words_of.pieces[i] if i >= 0 else extra[-1 - i] for i in counted.tolist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    n_tokens = int((sizes * times).sum())
    if not n_tokens:
        return n_words, word_chars, symbols, len(lines) - len(set(lines)), n_repeat, 0, None, None, None
    pieces = np.concatenate(own)
    uses = np.bincount(pieces, weights=np.repeat(times, sizes), minlength=len(words_of.is_byte))
    bytes_used = float(uses[words_of.is_byte].sum())
    share = uses[uses > 0] / n_tokens
    bits = float(-(share * np.log2(share)).sum())
    return (n_words, word_chars, symbols, len(lines) - len(set(lines)), n_repeat, n_tokens, word_chars / n_tokens, bytes_used / n_tokens,
            bits / np.log2(n_tokens) if n_tokens > 1 else 0.0)


def measures(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ``COLUMNS``) of every row.  Entropy is in units of its highest value for as many tokens.

    Null and empty texts have zeros and null measures.  The vocabulary file must be readable under this path on every machine.
    """
    chosen = docs.select(*[F.col(f"`{c}`") for c in (*keep, text_col)])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = vocabulary(path)
        for part in (p for batch in batches for p in slices(batch, at)):
            rows = list(zip(*[measure(t.as_py(), words_of) for t in part.column(at)], strict=True))
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:at], *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], [*part.schema.names[:at], *COLUMNS])
    fields = [T.StructField(c, T.LongType() if i < 6 else T.DoubleType()) for i, c in enumerate(COLUMNS)]
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:at], *fields]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def size_class() -> Column:
    """Tokens by powers of two; up to 63 are one class."""
    return F.greatest(F.lit(5), F.floor(F.log2("n_tokens"))).cast("int")


def blend(own: np.ndarray, weight: np.ndarray | float, prior: np.ndarray | float, evidence: np.ndarray | float) -> np.ndarray:
    """Between a value by ``weight`` texts and a prior by ``evidence`` texts, of which ``MIN_GROUP`` count at most; both by their cubes.

    So a few odd texts hardly move the prior, and a wrong prior hardly moves many texts.
    """
    w, e = np.power(weight, 3), np.power(np.minimum(evidence, MIN_GROUP), 3)
    return (w * own + e * prior) / np.maximum(w + e, 1e-300)


def nearby(values: np.ndarray, weights: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the mean of the values at the other places, near ones first, and how many texts speak for it."""
    decayed = np.where(places[:, None] == places, 0.0, weights * DECAY ** np.abs(places[:, None] - places))
    evidence = decayed.sum(axis=1)[:, None]
    return decayed @ values / np.maximum(evidence, 1e-300), evidence


def told(n: np.ndarray | Column, m: np.ndarray | Column) -> np.ndarray | Column:
    """How many texts speak for the step between groups of n and m texts."""
    return n * m / (n + m)


def shape_of_all(groups: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(for each size the sum of the languages' steps of each measure to the next size, the texts that speak for them, level of the entropy).

    Each language counts with ``MIN_GROUP`` texts of a size at most; a row for each size reaches the driver.
    """
    following = Window.partitionBy("grp").orderBy("cls")
    pair = F.least(F.lit(MIN_GROUP), told(F.col("n"), F.lead("n").over(following)))
    ahead = F.when(F.lead("cls").over(following) == F.col("cls") + 1, pair * pair / MIN_GROUP)
    steps = groups.select("cls", F.least("n", F.lit(MIN_GROUP)).alias("w"), "entropy", ahead.alias("ahead"), *[
        (F.lead(m).over(following) - F.col(m)).alias(f"{m}_step") for m in MEASURES])
    rows = steps.groupBy("cls").agg(F.sum("w"), F.sum(F.col("w") * F.col("entropy")), F.coalesce(F.sum("ahead"), F.lit(0.0)), *[
        F.coalesce(F.sum(F.col("ahead") * F.col(f"{m}_step")), F.lit(0.0)) for m in MEASURES]).collect()
    table = np.zeros((SIZES, 3 + len(MEASURES)))
    for row in rows:
        table[row[0]] = row[1:]
    sums, spoken, texts = table[:, 3:], table[:, 2], table[:, 0]
    height = heights(usual_steps(sums, spoken, sums, spoken))[:, MEASURES.index("entropy")]
    return sums, spoken, float((table[:, 1] - texts * height).sum() / max(texts.sum(), 1))


def usual_steps(sums: np.ndarray, spoken: np.ndarray, all_sums: np.ndarray, all_spoken: np.ndarray) -> np.ndarray:
    """The mean step from each size, the fewer texts speak for it the more like the steps of all texts at the sizes nearby."""
    near, _ = nearby(all_sums / np.maximum(all_spoken, 1e-300)[:, None], all_spoken, np.arange(SIZES))
    evidence = (all_spoken.sum() - all_spoken)[:, None]
    near = blend(near, evidence, 0.0, MIN_GROUP)
    return blend(sums / np.maximum(spoken, 1e-300)[:, None], spoken[:, None], near, MIN_GROUP)


def heights(step: np.ndarray) -> np.ndarray:
    """The sum of the steps up to each size."""
    return np.concatenate([np.zeros((1, step.shape[1])), np.cumsum(step, axis=0)[:-1]])


def middles_of(cls: np.ndarray, n: np.ndarray, medians: np.ndarray, shape: tuple) -> np.ndarray:
    """What is usual for the sizes of one language, by its medians (a row for each size, in order) and the shape of all languages."""
    sums, spoken, level = shape
    pairs = np.flatnonzero(np.diff(cls) == 1)
    weight, change = np.zeros(SIZES), np.zeros((SIZES, len(MEASURES)))
    weight[cls[pairs]] = told(n[pairs], n[pairs + 1])
    change[cls[pairs]] = medians[pairs + 1] - medians[pairs]
    put = np.square(np.minimum(weight, MIN_GROUP)) / MIN_GROUP  # by this language into the sums
    others = spoken - put
    rest = np.where(others > 1e-6, others, 0.0)
    shared = usual_steps(np.where(rest[:, None] > 0, sums - put[:, None] * change, 0.0), rest, sums, spoken)
    step = blend(change, weight[:, None], shared, MIN_GROUP)
    prior, evidence, height_of_all = np.zeros(medians.shape), np.zeros((len(cls), 1)), heights(usual_steps(sums, spoken, sums, spoken))[cls]
    for i, c in enumerate(cls):
        # A size's own median speaks for itself, and not again in the steps that lead to it.
        leading = step.copy()
        leading[c - 1:c + 1] = shared[c - 1:c + 1]
        height = heights(leading)
        found, by = nearby(medians - height[cls], n, cls)
        prior[i], evidence[i] = found[i] + height[c], by[i]
    evidence = np.repeat(evidence, len(MEASURES), axis=1)
    at = MEASURES.index("entropy")
    prior[:, at] = blend(prior[:, at], n.sum() - n, level + height_of_all[:, at], LEAN)
    evidence[:, at] += LEAN
    return blend(medians, n[:, None].astype(float), prior, evidence)


def bands(judged: DataFrame) -> DataFrame:
    """(grp_own, cls_own, then for each measure a struct of what is usual and the deviation) of every language and size among the texts.

    The deviation is that of the group's texts and, as ``MIN_GROUP`` texts, that of its size in all
    languages, each text's from the median of its own group, times how much more the language's texts deviate.
    """
    medians = [F.percentile_approx(m, 0.5, 1000).alias(m) for m in MEASURES]
    groups = written(judged.groupBy("grp", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"), *medians))
    shape = shape_of_all(groups)

    def middles(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        found = middles_of(rows["cls"].to_numpy(), rows["n"].to_numpy(), rows[list(MEASURES)].to_numpy(float), shape)
        return pd.DataFrame({"grp_own": rows["grp"], "cls_own": rows["cls"], **{f"{m}_mid": found[:, i] for i, m in enumerate(MEASURES)}})
    usual = written(groups.groupBy("grp").applyInPandas(middles, "grp_own string, cls_own int, " + ", ".join(f"{m}_mid double" for m in MEASURES)))
    medians = groups.select(F.col("grp").alias("grp_own"), F.col("cls").alias("cls_own"), *[F.col(m).alias(f"{m}_median") for m in MEASURES])
    same = F.col("grp").eqNullSafe(F.col("grp_own")) & (F.col("cls") == F.col("cls_own"))
    apart = judged.join(medians, same).select("grp_own", "cls_own", *[F.abs(F.col(m) - F.col(f"{m}_median")).alias(m) for m in MEASURES])
    spread = written(apart.cube("grp_own", "cls_own").agg(F.grouping_id().alias("over"), F.count(F.lit(1)).cast("double").alias("n"), *[F.greatest(
        F.percentile_approx(m, 0.5, 1000) * 1.4826, F.lit(FLOORS[m])).alias(m) for m in MEASURES]))
    # The bits of grouping_id tell what was not grouped by: 1 is a language, 2 a size, 3 all texts.
    every = spread.where("over = 3").select(F.col("n").alias("n_all"), *[F.col(m).alias(f"{m}_all") for m in MEASURES])
    sized = spread.where("over = 2").select(F.col("cls_own").alias("cls_sized"), F.col("n").alias("n_sized"), *[F.col(m).alias(f"{m}_sized") for m in MEASURES])
    lang = spread.where("over = 1").select(F.col("grp_own").alias("grp_lang"), F.col("n").alias("n_lang"), *[F.col(m).alias(f"{m}_lang") for m in MEASURES])
    own = spread.where("over = 0").drop("over").join(usual.withColumnsRenamed({"grp_own": "grp_mid", "cls_own": "cls_mid"}), F.col("grp_own").eqNullSafe(
        F.col("grp_mid")) & (F.col("cls_own") == F.col("cls_mid")))
    joined = own.join(lang, F.col("grp_own").eqNullSafe(F.col("grp_lang"))).join(sized, F.col("cls_own") == F.col("cls_sized")).crossJoin(every)

    def mean(value: Column, n: Column, prior: Column) -> Column:
        return (n ** 3 * value + MIN_GROUP ** 3 * prior) / (n ** 3 + MIN_GROUP ** 3)

    def deviation(m: str) -> Column:
        all_ = F.col(f"{m}_all")
        prior = mean(F.col(f"{m}_sized"), F.col("n_sized"), all_) * mean(F.col(f"{m}_lang"), F.col("n_lang"), all_) / all_
        return F.greatest(mean(F.col(m), F.col("n"), prior), F.lit(FLOORS[m]))
    return joined.select("grp_own", "cls_own", *[F.struct(F.col(f"{m}_mid").alias("mid"), deviation(m).alias("deviation")).alias(f"{m}_own") for m in MEASURES])


def main_script(text: Column) -> Column:
    """The script of most letters of a text, as ``script: Latin``; of equal numbers the first by name.

    Any Hiragana or Katakana makes Han Japanese, named by Hiragana.  Null texts and texts without a letter of ``SCRIPTS`` have ``script: other``.
    """
    counts = {s: F.coalesce(F.regexp_count(text, F.lit(f"\\p{{Is{s}}}")), F.lit(0)) for s in SCRIPTS}
    ranked = F.array_sort(F.array(*[F.struct((-n).alias("less"), F.lit(s).alias("script")) for s, n in counts.items()]))[0]
    most = F.when((ranked["script"] == "Han") & F.coalesce(text.rlike("[\\p{IsHiragana}\\p{IsKatakana}]"), F.lit(False)), F.lit("Hiragana")).otherwise(
        ranked["script"])
    return F.concat(F.lit("script: "), F.when(ranked["less"] == 0, F.lit("other")).otherwise(most))


def verdicts(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Measures of every row, ``base_failed`` and ``kept``.

    Bands come from the texts that pass the base rules, by the value of ``lang_col``, or where that
    is null by the script of most letters of the text.  A text is rejected if it fails the base rules or lies outside a band; texts that
    pass the base rules have tokens.  Repeated rows each count.  Other columns are not looked at,
    whatever their names.  An empty table gives an empty table.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("grp"), F.col(f"`{text_col}`").alias("text"))
    chosen = chosen.withColumn("grp", F.when(F.col("grp").isNull(), main_script(F.col("text"))).otherwise(F.col("grp")))
    measured = measures(chosen, path, "text", ("id", "grp"))
    measured = written(measured.withColumn("base_failed", base_failed()).withColumn("cls", size_class()))
    judged = measured.where("NOT base_failed").select("grp", "cls", *MEASURES)
    own = bands(judged)
    joined = measured.join(own, F.col("grp").eqNullSafe(F.col("grp_own")) & (F.col("cls") == F.col("cls_own")), "left")
    off = {m: (F.col(m) - F.col(f"{m}_own")["mid"]) / F.col(f"{m}_own")["deviation"] for m in MEASURES}
    reach = 1 + F.lit(SLACK) / F.sqrt(F.greatest(F.lit(1), "n_tokens"))
    inside = off["chars_per_token"] + off["entropy"] >= -JOINT_WIDTH * reach
    for m in MEASURES:
        inside &= F.abs(off[m]) <= WIDTH * reach
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(F.col("id").alias(id_col), *COLUMNS, "base_failed", kept.alias("kept"))
