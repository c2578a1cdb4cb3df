"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import (
    alignment,
    block_naming,
    canonical,
    disclosure,
    mixing,
    packing,
    prefix_counts,
    quality,
    simhash,
    simple8b,
    spelling,
    toxicity,
    warc,
)
from framewright.storage import new_path

SUBWORDS = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_file(name: str = SUBWORDS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_data(documents(spark, sf_dir))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, language, topic, tokens, weight and chance of every document drawn."""
    return mixing.draw(documents(spark, sf_dir)).select("doc_id", "mix.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, radius=3)


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(documents(spark, sf_dir), tokenizer_file())


def op8_canonical_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.edit_report(documents(spark, sf_dir))


def op9_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "simple8b")
    simple8b.write_files(documents(spark, sf_dir), path, tokenizer_file())
    return simple8b.read_files(spark, path)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_pages(spark, path)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), tokenizer_file(), tokenizer_file(PIECES))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

#: A word's near words: it and another give the same string when one code point of each, or of the longer one, is masked or left out.
OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS owner,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
counted AS (SELECT owner, run, count(*) AS times, hex(encode(owner || ':' || run)) AS bytes FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
           list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || bytes[2 * i + 1 : 2 * i + 2] AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
  FROM counted, crc_table
),
written AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM cuts),
less AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM cuts),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.k = b.k AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.k
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.k
),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.most >= 2 * w.n THEN b.near END AS form, CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
led AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l ON l.word = f.word JOIN formed e ON e.word = l.root WHERE e.form IS NULL
"""

OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM d
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_disclosure_sanitisation": op3_disclosure_sanitisation,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_quality": op5_quality,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_prefix_token_counts": op7_prefix_token_counts,
    "op8_canonical_fingerprints": op8_canonical_fingerprints,
    "op9_simple8b_token_files": op9_simple8b_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_warc": OP12_SQL,
}
