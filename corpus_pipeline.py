"""A corpus made ready for training: language ID, near-duplicates, PII, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.llm import bpe, langid, mixing, pii, simhash
from clinisieve.llm.common import fresh
from clinisieve.llm.queries import BPE_FILE
from clinisieve.sources.scratch import written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; those without a letter, or between two languages, go."""
    model = langid.train_on(docs)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.predictions(docs, model, "text", lang, score)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= langid.AMBIGUOUS)).drop(lang, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.one_per_group(docs, width=3, max_bits=3)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for personal numbers and dates; ``n_chars`` follows the text."""
    out = pii.with_pseudonyms(docs, "text", key=pii.session_key(spark))
    length = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents once for each epoch, cut at the budgets of their sources."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    path, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    encoded = bpe.tokenized(docs.select("doc_id", "lang", "source", "text"), "text", path, pattern)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("language ID", identify_languages),
    ("SimHash near-dedup", near_dedup),
    ("PII pseudonyms", pseudonymise),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The languages, fingerprints and merges are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each on a written table of what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
