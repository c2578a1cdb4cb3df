"""Set operations over tables, their columns and their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_columns(tables: list[DataFrame]) -> list[str]:
    """Columns that all tables have, in the first one's order; there must be some."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    if not shared:
        raise ValueError("the tables have no column in common")
    return shared


def union_common(tables: list[DataFrame], index: str = "dataset_index") -> DataFrame:
    """All rows over the common columns, with the table's number."""
    columns = common_columns(tables)
    return reduce(DataFrame.unionByName, [t.select(*columns, F.lit(k).alias(index)) for k, t in enumerate(tables)])


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side ("missing": in left alone, "extra": in right alone)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("extra"))
    )


def ordered_distinct(rows: DataFrame, value: str, place: str, into: str = "first_place") -> DataFrame:
    """Each value with the first place it stands at."""
    return rows.groupBy(value).agg(F.min(place).alias(into))


def distinct_within(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The set of values of each key, sorted."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(f"{value}s"))
