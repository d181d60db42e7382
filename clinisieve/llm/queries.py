"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinisieve.llm import bpe, fixity, langid, licenses, manifest, mixing, negatives, pii, quality, repeats, simhash, sketch, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_pseudonyms(docs, key=pii.session_key(spark), kinds="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("bigint").alias("n_pseudonyms"), F.array_join("kinds", ",").alias("kinds"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"), width=3, max_bits=3)
    return groups.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_fingerprints(_read(spark, sf_dir, "documents"))
    own, edited, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        sketch.resemblance(own, edited).alias("near_edited"), sketch.resemblance(own, following).alias("near_next"),
        sketch.containment(own, edited).alias("kept_share"), sketch.distinct_shingles(own).alias("n_shingles"))


PIECE_FILE = "piece_bpe_32k.model"


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_read(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                        F.size("starts").cast("bigint").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def damaged_pages(pages: DataFrame) -> DataFrame:
    """A replica of the pages with faults planted by their numbers: a changed byte, a cut body, a lost record."""
    page = F.col("page_id")
    html = F.when(page % 211 == 17, F.overlay(F.col("html"), F.lit("#"), F.lit(20))).when(
        page % 1009 == 400, F.left(F.col("html"), F.lit(100))).otherwise(F.col("html"))
    return pages.where("page_id % 1511 <> 700").select("page_id", "url", html.alias("html"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = fixity.audit(fixity.warc_records(pages), fixity.warc_records(damaged_pages(pages)))
    return found.select(F.col("record_id").alias("page_id"), "file", "offset", "n_bytes", "digest", "state")


OP6_SQL = r"""
WITH replicas AS (
  SELECT 0 AS replica, page_id, url, html FROM pages
  UNION ALL
  SELECT 1, page_id, url, CASE WHEN page_id % 211 = 17 THEN substr(html, 1, 19) || '#' || substr(html, 21)
                               WHEN page_id % 1009 = 400 THEN left(html, 100) ELSE html END FROM pages WHERE page_id % 1511 <> 700),
records AS (
  SELECT replica, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM replicas),
placed AS (
  SELECT replica, page_id, page_id // 1024 AS file, strlen(record) AS n_bytes, sha256(record) AS digest,
    (sum(strlen(record)) OVER (PARTITION BY replica, page_id // 1024 ORDER BY page_id))::BIGINT - strlen(record) AS "offset"
  FROM records)
SELECT a.page_id, a.file, a."offset", a.n_bytes, a.digest,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed' ELSE 'intact' END AS state
FROM (SELECT * FROM placed WHERE replica = 0) a LEFT JOIN (SELECT * FROM placed WHERE replica = 1) b USING (page_id)
"""


BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    docs = bpe.tokenized(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, pattern)
    return docs.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train_on(docs)
    found = langid.predictions(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        (F.col("score") < langid.AMBIGUOUS).alias("ambiguous"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM base GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(number - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(coalesce((SELECT max(level) FROM levels WHERE level <= ratio), (SELECT max(ratio) FROM levels)) * weight, cap) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id))::BIGINT - size AS start
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - start, 0), size) END)::BIGINT AS taken
FROM placed
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


OP11_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.col("n_chars") + F.when(hit, 1).otherwise(0)}
    found = manifest.manifest(_read(spark, sf_dir, "documents"), tampered=tampered)
    path = F.col("path")
    found = found.withColumn("folded_root", manifest.folded(F.col("tampered_leaf"), path))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(path).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


#: DuckDB has no crc32, so it is worked out bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql(f"n_chars + CASE WHEN {_CRC_SQL} % 7 = 0 THEN 1 ELSE 0 END")} AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, {_leaf_sql("n_chars")}) - 1 AS pos FROM documents),
nodes AS (
  SELECT lang, 0 AS level, pos AS idx, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, pos AS idx, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 2),
steps AS (
  SELECT l.lang, l.pos, 0 AS phase, a.level, a.idx % 2 = 1 AS is_right, s.d AS sibling
  FROM leaves l JOIN nodes a ON a.lang IS NOT DISTINCT FROM l.lang AND a.n > 1 AND a.idx = l.pos >> a.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM a.lang AND s.level = a.level AND s.idx = xor(a.idx, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1, a.level, a.idx % 2 = 1, s.d
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN upper_nodes a ON a.n > 1 AND a.idx = r.pos >> a.level
  LEFT JOIN upper_nodes s ON s.level = a.level AND s.idx = xor(a.idx, 1)),
paths AS (
  SELECT lang, pos, list(CASE WHEN is_right THEN 'L' ELSE 'R' END || coalesce(sibling, '') ORDER BY phase, level) AS path,
         sha256(string_agg(coalesce(sibling, ''), '' ORDER BY phase, level)) AS proof FROM steps GROUP BY lang, pos),
folded AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT d FROM upper_nodes WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(l.tampered, coalesce(p.path, [])),
           lambda digest, s: sha256(CASE WHEN s[1] = 'L' THEN substr(s, 2) || digest ELSE digest || substr(s, 2) END)) AS folded_root
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

WORD_FILE = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    found = tokencount.token_counts(docs.select("doc_id", n_bytes.alias("n_bytes"), "text"), "text", public_tokenizers.path(WORD_FILE))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


for _query in (op1_pii_pseudonyms, op2_simhash_near_dedup, op3_document_fingerprints, op4_quality_rules, op5_suffix_array_dedup,
               op6_merkle_fixity, op7_byte_bpe, op8_license_scans, op9_language_id, op10_mixing, op11_hard_negatives, op12_merkle_manifest, op13_token_counts):
    QUERIES[_query.__name__] = _query
ORACLE["op6_merkle_fixity"] = OP6_SQL
ORACLE["op10_mixing"] = OP10_SQL
ORACLE["op11_hard_negatives"] = OP11_SQL
ORACLE["op12_merkle_manifest"] = OP12_SQL
