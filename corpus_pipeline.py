"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Null and empty texts are kept by the classifier, equal each other in the exact stage (one row stays), make one
group of the near-copy stage, and are drawn and packed as a document of the end id alone.  Very long texts are
scored, compared and packed whole; packing cuts them into pieces.  Of rows that repeat another, or tie, one stays as each stage
defines it (the largest doc_id of equal texts, the smallest of near copies).  Null sources and languages are values
of their own.  An empty table gives no rows.  Further columns are kept up to the last stage, whatever their names.

A stage begins by having the executors give back what the one before it left in their heaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import block_naming, mixing, packing, simhash, toxicity
from framewright.llm.memory import give_back
from framewright.llm.registry import labels, tokenizer_file
from framewright.shipping import shipped
from framewright.storage import materialize

#: Units that a worker remembers while it tokenizes: fewer than by default, since workers outlive the stages before.
KEPT_UNITS = 60_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@shipped
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


@shipped
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return block_naming.drop_exact_duplicates(docs)


@shipped
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; one document of each group stays."""
    give_back(spark)
    return simhash.drop_similar(docs)


@shipped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return mixing.sample_to_targets(docs)


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return packing.pack_documents(docs, tokenizer_file(), kept_units=KEPT_UNITS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: The classifier, the search trees and the packing have no SQL; tests/llm/test_pipeline.py holds a plain version against them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
