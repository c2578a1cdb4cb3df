"""Values at other times or places than those measured, by linear interpolation between the two neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(queries: DataFrame, samples: DataFrame, by: str, at: str, value: str, into: str = "interpolated") -> DataFrame:
    """``queries`` (by, at) with ``into``: the value of ``samples`` (by, at, value) there, by the line between the last sample not after and the next.

    One shuffle by ``by``: a sample carries its successor along, so that one running look back finds both neighbours.  Before
    the first sample and after the last, the nearest one's value holds; without samples it is null.  Of samples of one time,
    the largest value counts.  Null values are no samples.
    """
    known = samples.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    known = known.groupBy(F.col(by).alias("k"), F.col(at).cast("double").alias("t")).agg(F.max(F.col(value).cast("double")).alias("v"))
    in_order = Window.partitionBy("k").orderBy("t")
    known = known.select("k", "t", F.struct("t", "v", F.lead("t").over(in_order).alias("t2"), F.lead("v").over(in_order).alias("v2")).alias("s"))
    first = known.groupBy("k").agg(F.min_by("s.v", "t").alias("v0"))
    # The queries' own columns travel in a struct, so that theirs may have any names.
    asked = queries.select(F.col(by).alias("k"), F.col(at).cast("double").alias("t"), F.struct("*").alias("row"))
    both = asked.unionByName(known, allowMissingColumns=True)
    asks = F.col("row").isNotNull()
    back = F.last("s", ignorenulls=True).over(Window.partitionBy("k").orderBy("t", asks).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("b", back).filter(asks).join(first, "k", "left")
    weight = (F.col("t") - F.col("b.t")) / (F.col("b.t2") - F.col("b.t"))
    line = F.when(F.col("b.t2").isNull() | (F.col("t") == F.col("b.t")), F.col("b.v")).otherwise(F.col("b.v") * (1 - weight) + F.col("b.v2") * weight)
    told = F.when(F.col("t").isNull(), F.lit(None)).when(F.col("b").isNull(), F.col("v0")).otherwise(line)
    return seen.select(*[F.col(f"row.`{c}`").alias(c) for c in queries.columns], told.alias(into))


def even_positions(length: Column, n: int) -> Column:
    """``n`` places from 0 to ``length`` - 1, evenly spaced with both ends (one place: the first)."""
    step = (length - 1).cast("double") / F.lit(max(n - 1, 1)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.cast("int").alias("k"), (k * step).alias("position")))


def resample(frames: DataFrame, by: str, frame: str, value: str, n: int) -> DataFrame:
    """by, k, position, value of ``n`` even places between the first and the last frame of each ``by``; frames are numbered from 0."""
    sizes = frames.groupBy(by).agg((F.max(frame) + 1).alias("length"))
    asked = sizes.select(by, F.inline(even_positions(F.col("length"), n)).alias("k", frame))
    found = interpolate(asked, frames.select(by, frame, value), by, frame, value, into="resampled")
    return found.select(by, "k", F.col(frame).alias("position"), F.col("resampled").alias(value))
