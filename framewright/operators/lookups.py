"""Lookups: tasks, annotations in several roles, new keys, caches by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.storage import broadcast_within, materialize

DIMENSION_ROWS = 100_000


def last_wins(rows: DataFrame, key: str, place: str) -> DataFrame:
    """One row per key: the one that comes last."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), place).alias("r")).select(key, "r.*")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, dimension_key: str | None = None, into: str | None = None) -> DataFrame:
    """``rows`` with the dimension's value for their key; null where there is none."""
    named = dimension.select(F.col(dimension_key or key).alias("__k"), F.col(value).alias(into or value))
    return rows.join(named, F.col(key) == F.col("__k"), "left").drop("__k")


def require_lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, dimension_key: str | None = None, into: str | None = None) -> DataFrame:
    """The same; fails on a key that the dimension lacks."""
    name = into or value
    fail = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
    return lookup(rows, dimension, key, value, dimension_key, into).withColumn(
        name, F.coalesce(F.col(name), fail.cast(dimension.schema[value].dataType))
    )


def roles(rows: DataFrame, dimension: DataFrame, dimension_key: str, value: str, keys: dict[str, str]) -> DataFrame:
    """The dimension joined once for each role: ``keys`` maps key columns, those that exist, to names."""
    for key, name in keys.items():
        if key in rows.columns:
            rows = lookup(rows, dimension, key, value, dimension_key, name)
    return rows


def first_of(*names: str) -> Column:
    """The first of several looked-up values that is there."""
    return F.coalesce(*map(F.col, names))


def with_new_keys(known: DataFrame, texts: DataFrame, text: str, index: str) -> DataFrame:
    """text, index of all texts: known ones keep their index, new ones go on from the largest, in order of the text."""
    fresh = texts.select(text).distinct().join(known, text, "left_anti")
    top = known.agg(F.coalesce(F.max(index), F.lit(-1)).alias("top"))
    number = F.row_number().over(Window.orderBy(text))  # new tasks only, a dimension
    added = fresh.crossJoin(F.broadcast(top)).select(text, (F.col("top") + number).cast("long").alias(index))
    return known.select(text, F.col(index).cast("long").alias(index)).unionByName(added)


def cache_misses(keys: DataFrame, caches: DataFrame, key: str, cache: str) -> DataFrame:
    """Keys that at least one cache lacks."""
    n = caches.select(cache).distinct().agg(F.count("*").alias("n"))
    held = caches.select(key, cache).distinct().groupBy(key).agg(F.count("*").alias("held"))
    found = keys.select(key).distinct().join(held, key, "left").crossJoin(F.broadcast(n))  # one row
    return found.filter(F.coalesce("held", F.lit(0)) < F.col("n")).select(key)


def upsert_counts(keys: DataFrame, cached: DataFrame, key: str, overwrite: bool, by: str | None = None) -> DataFrame:
    """new, overwritten, skipped: what writing ``keys`` to the cache does."""
    marked = keys.join(cached.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    there = F.col("__there").isNotNull()
    grouped = marked.groupBy(by) if by else marked.groupBy()
    return grouped.agg(
        F.count_if(~there).alias("new"),
        F.count_if(there & F.lit(overwrite)).alias("overwritten"),
        F.count_if(there & F.lit(not overwrite)).alias("skipped"),
    )


def role_indices(rows: DataFrame, known: DataFrame, texts: dict[str, str], text: str, index: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with an index for each of several texts, and the table that gives it: texts that are new are added.

    ``texts`` maps text columns to names of index columns.  All texts share one numbering.  A null text has a null index.
    """
    each = F.explode(F.array(*[F.col(c) for c in texts])).alias(text)
    table = materialize(with_new_keys(known, rows.select(each).filter(F.col(text).isNotNull()), text, index), "text-indices")
    small = broadcast_within(table, DIMENSION_ROWS)
    for column, name in texts.items():
        rows = lookup(rows, small, column, index, text, name)
    return rows, table
