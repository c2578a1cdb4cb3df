"""Labelled documents to learn from: a bounded, repeatable sample joined with whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.text import text_of
from framewright.storage import materialize


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """text, label (0 or 1), order of at most ``most`` labelled rows with ``keep``: those with the least hashes of doc_id.

    Null labels are left out; a doc_id labelled twice counts as 1 if either row says so.  Rows that repeat a doc_id each
    count as one, so the bound holds for them too.  The labels are the side that is broadcast, within the bound.
    """
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.filter(F.col("__id").isNotNull() & F.col("label").isNotNull())
    chosen = chosen.groupBy("__id").agg(F.max("label").alias("label")).withColumnRenamed("__id", "doc_id").filter(keep)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col(doc_id).alias("__doc"), text_of(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    rows = rows.select("text", "label", F.xxhash64("__doc").alias("place"), F.xxhash64("__doc", "text").alias("order"))
    rows = materialize(rows, "training")
    if rows.count() > most:
        rows = materialize(rows.orderBy("place", "order").limit(most), "training-cut")
    return rows.drop("place")
