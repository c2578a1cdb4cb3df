"""Summaries of bounded size that are stored by part and merged: distinct counts (HLL) and quantiles (KLL).

A part's sketches are written once; any grouping of the parts is answered from them, without the rows.  Groups of at most
``exact`` rows hold their values as well, and give exact answers as long as the merged group is that small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers; the standard error of a distinct count is about 1.04 / sqrt(2**LG_K), or 1.6 %.
LG_K = 12
#: The rank error of a quantile is about 1.33 % with this size (normalised, of one quantile, 99 % sure).
KLL_K = 200
RANK_ERROR = 0.0133
EXACT = 1_000


def distinct_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def partial(rows: DataFrame, keys: list[str], x: str, item: str, exact: int = EXACT) -> DataFrame:
    """keys, n, hll of ``item``, kll of ``x`` (a number) and, of groups of at most ``exact`` rows, their values and items.

    The counts come first, and only groups known to be small are gathered, so no group holds more than ``exact`` values at a time.
    Groups with a null key have sketches alone.
    """
    number = F.col(x).cast("double")
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(item).cast("string"), F.lit(LG_K)).alias("hll"),
        F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias("kll"),
    )
    small = whole.filter(F.col("n") <= exact).select(*keys)
    held = rows.join(small, keys, "left_semi").groupBy(*keys).agg(
        F.collect_list(number).alias("values"), F.collect_set(F.col(item).cast("string")).alias("items")
    )
    return whole.join(held, keys, "left")


def merged(parts: DataFrame, keys: list[str], exact: int = EXACT) -> DataFrame:
    """Parts summed to coarser keys; values are kept while the group has at most ``exact`` rows and all its parts have theirs."""
    total = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll").alias("kll"),
        F.bool_and(F.col("values").isNotNull()).alias("whole"),
    )
    fits = total.filter(F.col("whole") & (F.col("n") <= exact)).select(*keys)
    held = parts.join(fits, keys, "left_semi").groupBy(*keys).agg(
        F.flatten(F.collect_list("values")).alias("values"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return total.drop("whole").join(held, keys, "left")


def distinct_count() -> Column:
    """Of a row of ``partial`` or ``merged``: exact for small groups, else the estimate."""
    return F.when(F.col("items").isNotNull(), F.size("items").cast("long")).otherwise(F.hll_sketch_estimate("hll"))


def quantile(q: float) -> Column:
    """The least value with at least a share ``q`` of the values at or below it: exact for small groups, else the estimate."""
    ordered = F.array_sort("values")
    place = F.greatest(F.ceil(F.lit(q) * F.size("values")).cast("int"), F.lit(1))
    return F.when(F.size("values") > 0, F.element_at(ordered, place)).otherwise(F.kll_sketch_get_quantile_double("kll", F.lit(q)))


def is_exact() -> Column:
    return F.col("values").isNotNull()
