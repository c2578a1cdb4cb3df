"""Frames in time: offset windows with padding masks, sliding windows, regular steps, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(episode: str, frame: str) -> tuple:
    ordered = Window.partitionBy(episode).orderBy(frame)
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def shifted(value: Column, delta: int, ordered, whole) -> Column:
    """The value ``delta`` frames on, held at the episode's ends."""
    if not delta:
        return value
    moved, held = (F.lead(value, delta), F.last(value)) if delta > 0 else (F.lag(value, -delta), F.first(value))
    place, last = F.row_number().over(ordered), F.count(F.lit(1)).over(whole)
    inside = (place + delta <= last) & (place + delta >= 1)
    return F.when(inside, moved.over(ordered)).otherwise(held.over(whole))


def delta_window(frames: DataFrame, value: str, deltas: list[int], episode: str, frame: str = "frame_index") -> DataFrame:
    """``frames`` with ``window`` (values at the deltas, held at the ends) and ``is_pad`` (true where held).

    One shuffle by episode; all deltas share the sort.
    """
    ordered, whole = _whole(episode, frame)
    place, last = F.row_number().over(ordered) - 1, F.count(F.lit(1)).over(whole)
    pads = [((place + d < 0) | (place + d >= last)) for d in deltas]
    return frames.withColumns(
        {"window": F.array(*[shifted(F.col(value), d, ordered, whole) for d in deltas]), "is_pad": F.array(*pads)}
    )


def delta_rows(frames: DataFrame, value: str, deltas: list[int], episode: str, frame: str = "frame_index") -> DataFrame:
    """``delta_window`` with a row for each delta: delta, value, is_pad."""
    gathered = delta_window(frames, value, deltas, episode, frame)
    zipped = F.arrays_zip(F.array(*map(F.lit, deltas)).alias("delta"), F.col("window").alias("v"), F.col("is_pad").alias("p"))
    return gathered.select(episode, frame, F.explode(zipped).alias("z")).select(
        episode, frame, F.col("z.delta").alias("delta"), F.col("z.v").alias("value"), F.col("z.p").alias("is_pad")
    )


def unpadded(frames: DataFrame, deltas: list[int], episode: str, frame: str = "frame_index") -> DataFrame:
    """Frames whose window needs no padding."""
    ordered, whole = _whole(episode, frame)
    place, last = F.row_number().over(ordered) - 1, F.count(F.lit(1)).over(whole)
    return frames.withColumns({"__p": place, "__n": last}).filter(
        (F.col("__p") + min(deltas) >= 0) & (F.col("__p") + max(deltas) < F.col("__n"))
    ).drop("__p", "__n")


def with_padding(frames: DataFrame, deltas: list[int], episode: str, frame: str = "frame_index", into: str = "has_pad") -> DataFrame:
    """``frames``, each told whether its window needs padding."""
    ordered, whole = _whole(episode, frame)
    place, last = F.row_number().over(ordered) - 1, F.count(F.lit(1)).over(whole)
    return frames.withColumn(into, (place + min(deltas) < 0) | (place + max(deltas) >= last))


def sliding_window(frames: DataFrame, value: str, width: int, episode: str, frame: str = "frame_index") -> DataFrame:
    """``frames`` with ``chunk``: this and the next values, ``width`` in all, the last repeated at the end."""
    ahead = Window.partitionBy(episode).orderBy(frame).rowsBetween(0, width - 1)
    got = F.collect_list(value).over(ahead)
    return frames.withColumn("__got", got).withColumn(
        "chunk", F.concat("__got", F.array_repeat(F.element_at("__got", -1), F.lit(width) - F.size("__got")))
    ).drop("__got")


def irregular_steps(frames: DataFrame, time: str, step: float, tolerance: float, episode: str, frame: str = "frame_index") -> DataFrame:
    """Frames whose time since the frame before differs from ``step`` by more than the tolerance."""
    since = F.col(time) - F.lag(time).over(Window.partitionBy(episode).orderBy(frame))
    return frames.withColumn("since", since).filter(F.abs(F.col("since") - step) > tolerance)


def delta_indices(seconds: list[float], fps: float, tolerance: float = 1e-4) -> list[int]:
    """Offsets in seconds as frames; each must be a multiple of 1/fps within the tolerance."""
    bad = [s for s in seconds if abs(s * fps - round(s * fps)) / fps > tolerance]
    if bad:
        raise ValueError(f"not multiples of 1/{fps}: {bad}")
    return [round(s * fps) for s in seconds]


def nearest_index(seconds: Column, fps: float) -> Column:
    """Seconds as frames, halves to the even one."""
    return F.bround(seconds * fps).cast("long")


def off_grid(seconds: Column, fps: float, tolerance: float = 1e-4) -> Column:
    """Whether the seconds are no multiple of 1 / fps within the tolerance."""
    return F.abs(seconds * fps - F.bround(seconds * fps)) / fps > tolerance


def window_deltas(size: int, stride: int, past: int = 0) -> list[int]:
    """Deltas of a window of ``size`` steps of ``stride`` frames, ``past`` of them before the anchor."""
    return [stride * k for k in range(-past, size - past)]


def nearest(
    queries: DataFrame, frames: DataFrame, by: str, time: str, tolerance: float, strict: bool = True
) -> DataFrame:
    """Each query (by, time) with the nearest frame of the same ``by``: found_time, distance; the earlier one on ties.

    ``time`` is a number in both.  Times are put into bins as wide as the tolerance; a query meets its own bin and the
    two beside it in an equi-join, so no product is formed.  Queries without a frame within the tolerance get nulls.
    """
    bins = F.floor(F.col(time) / tolerance).cast("long")
    near = queries.withColumn("__bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    there = frames.select(by, F.col(time).alias("found_time"), bins.alias("__bin"))
    distance = F.abs(F.col(time) - F.col("found_time"))
    hit = near.join(there, [by, "__bin"]).withColumn("distance", distance)
    hit = hit.filter(F.col("distance") < tolerance if strict else F.col("distance") <= tolerance)
    best = hit.groupBy(by, time).agg(F.min(F.struct("distance", "found_time")).alias("best"))
    return queries.join(best, [by, time], "left").select(*queries.columns, "best.found_time", "best.distance")


def require_matches(matched: DataFrame) -> DataFrame:
    """Fails on a query that ``nearest`` found no frame for."""
    fail = F.raise_error(F.lit("a time has no frame within the tolerance")).cast("double")
    return matched.withColumn("distance", F.when(F.col("distance").isNull(), fail).otherwise(F.col("distance")))


def pool_mask(rows: DataFrame, keys: list[str], place: str, mask: str, factor: int) -> DataFrame:
    """Groups of ``factor`` frames after the first; a group is padded if all its frames are.  The first is group 0."""
    group = F.when(F.col(place) == 0, 0).otherwise(1 + F.floor((F.col(place) - 1) / factor)).cast("long")
    return rows.groupBy(*keys, group.alias("pooled")).agg(F.bool_and(mask).alias("is_pad"))


def causal_mask(n: DataFrame, query: str, key: str) -> Column:
    """Whether a query may see a key: not later than itself."""
    return F.col(query) >= F.col(key)


def stride(values: Column, ratio: int) -> Column:
    """Every ``ratio``-th element from the first."""
    return F.filter(values, lambda x, i: i % ratio == 0)


def strided(rows: DataFrame, place: str, ratio: int) -> DataFrame:
    """The rows at every ``ratio``-th place from 0."""
    return rows.filter((F.col(place) >= 0) & (F.col(place) % ratio == 0))


def group_causal(query: Column, key: Column, size: int) -> Column:
    """Whether a query's group is not before the key's; the first group is seen by all."""
    return (key < size) | (F.floor(query / size) >= F.floor(key / size))


def same_group(query: Column, key: Column, size: int) -> Column:
    return F.floor(query / size) == F.floor(key / size)
