"""Rows dealt to overlapping tiles, and the tiles' results blended again by ramps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, place: str, length: str, size: int, step: int) -> DataFrame:
    """``rows`` (at ``place`` of ``length``) with a row for each tile that holds them: tile (its start), in_tile, weight.

    Tiles of a row are told by its place, so nothing is joined: a row goes to about size / step of them.  The weight rises from
    1 / border to 1 over the ``size`` - ``step`` places after a start, and falls likewise, but not at the ends of the whole.
    """
    if not 0 < step <= size:
        raise ValueError("tiles must not leave gaps")
    at, whole, border = F.col(place).cast("long"), F.col(length).cast("long"), size - step
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("long")
    here = F.transform(F.sequence(first, F.floor(at / step).cast("long")), lambda k: k * step)
    here = F.filter(here, lambda s: ((s == 0) | (s - step + size < whole)) & (s <= at) & (at < s + size))
    dealt = rows.withColumn("tile", F.explode(here)).withColumn("in_tile", at - F.col("tile"))
    shown = F.least(F.col("tile") + size, whole) - F.col("tile")  # places of the tile that there are
    left, ramp = shown - F.col("in_tile"), F.lit(max(border, 1)).cast("double")  # left: places up to the tile's end, this one included
    fall = F.when((F.col("tile") + size < whole) & (left <= border), left / ramp)
    rise = fall.when((F.col("tile") > 0) & (F.col("in_tile") < border), (F.col("in_tile") + 1) / ramp)
    return dealt.withColumn("weight", rise.otherwise(1.0))


def blended(tiles: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """keys and the weighted mean of what the tiles say of each place."""
    w = F.col(weight)
    return tiles.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value), F.count("*").alias("tiles"))
