"""Samples that can't be used are replaced by others, drawn by hash: the same ones every time.

A sample that is padded or can't be read tries up to ``tries`` others, each a place among all samples told by the md5 of
seed, place and number of the try.  All tries are rows of one table, which meets the usable places once, however many
tries there are; the first that met is taken.  Only unusable samples are tried, so the work grows with them, and places told by a hash
spread evenly over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES = 5


def tried(place: Column, k: Column, total: int, seed: int = 0) -> Column:
    """The place that the ``k``-th try draws among ``total``."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), place.cast("string"), k.cast("string")).cast("binary"))
    return F.conv(F.substring(told, 1, 15), 16, 10).cast("long") % F.lit(max(total, 1))


def redraw(samples: DataFrame, place: str = "place", ok: str = "ok", tries: int = TRIES, seed: int = 0) -> DataFrame:
    """place, drawn, tries_made, last of every sample; ``samples`` are at places from 0 on without a gap.

    ``drawn`` is the sample itself where it is usable, else the first usable one tried, null if none is.  ``last`` is
    the last one tried.  A null in ``ok`` counts as not usable.
    """
    rows = samples.select(F.col(place).cast("long").alias("place"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    total = rows.count()
    k = F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("k")
    wanting = rows.filter("NOT ok").select("place", k) if tries else rows.filter("NOT ok").select("place", F.lit(0).alias("k")).limit(0)
    wanting = wanting.withColumn("found", tried(F.col("place"), F.col("k"), total, seed))
    usable = rows.filter("ok").select(F.col("place").alias("found"))
    first = wanting.join(usable, "found").groupBy("place").agg(F.min(F.struct("k", "found")).alias("first"))
    met = rows.join(first, "place", "left")
    return met.select(
        "place",
        F.when(F.col("ok"), F.col("place")).otherwise(F.col("first.found")).alias("drawn"),
        F.when(F.col("ok"), 0).otherwise(F.coalesce("first.k", F.lit(tries))).cast("int").alias("tries_made"),
        F.when(F.col("ok") | F.lit(tries == 0), F.col("place")).otherwise(F.coalesce("first.found", tried(F.col("place"), F.lit(tries), total, seed))).alias("last"),
    )


def serve(samples: DataFrame, drawn: DataFrame, place: str = "place", by: str = "drawn") -> DataFrame:
    """``samples`` as drawn: the row of every place is that of the sample drawn for it, which ``by`` names.

    With ``by="last"``, a place that found no usable sample gets the last one tried, as it is.
    """
    chosen = drawn.select(F.col("place").alias(place), F.col(by).alias("served_from"))
    rows = samples.withColumnRenamed(place, "served_from")
    return chosen.join(rows, "served_from").select(place, "served_from", *[c for c in samples.columns if c != place])


def unserved(drawn: DataFrame) -> DataFrame:
    """The places for which no try found a usable sample."""
    return drawn.filter(F.col("drawn").isNull()).select("place", "tries_made")


def require_served(drawn: DataFrame) -> DataFrame:
    """Fails on a place for which no try found a usable sample."""
    told = F.concat(F.lit("no usable sample in "), F.col("tries_made").cast("string"), F.lit(" tries for "), F.col("place").cast("string"))
    return drawn.withColumn("drawn", F.when(F.col("drawn").isNull(), F.raise_error(told).cast("long")).otherwise(F.col("drawn")))
