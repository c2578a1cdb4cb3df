"""Episodes: frames numbered in order, selected, checked, split and laid end to end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.names import unused
from framewright.operators.intervals import overlaps


def number_frames(rows: DataFrame, episode: str, *order: str, into: str = "frame_index") -> DataFrame:
    """``rows`` with their place in the episode, from 0."""
    place = F.row_number().over(Window.partitionBy(episode).orderBy(*order))
    return rows.withColumn(into, (place - 1).cast("long"))


def number_frames_in_blocks(rows: DataFrame, episode: str, time: str, width: float, *order: str, into: str = "frame_index") -> DataFrame:
    """The same numbers, counted within blocks of ``width`` units of ``time`` (a number, the first of the order), then laid end to end.

    No task orders a whole episode: one of a third of all rows is spread over its blocks.  What meets by episode is a row a block.
    """
    block, count, base = unused(rows, "block", "count", "base")
    dealt = rows.withColumn(block, F.floor(F.col(time) / F.lit(width)).cast("long"))
    sizes = dealt.groupBy(episode, block).agg(F.count("*").alias(count))
    before = F.sum(count).over(Window.partitionBy(episode).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(episode).alias(f"{base}_e"), F.col(block).alias(f"{base}_b"), F.coalesce(before, F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(episode, block).orderBy(time, *order)) - 1
    met = dealt.withColumn(into, inside).join(sizes, F.col(episode).eqNullSafe(F.col(f"{base}_e")) & F.col(block).eqNullSafe(F.col(f"{base}_b")))
    return met.withColumn(into, (F.col(into) + F.col(base)).cast("long")).drop(block, base, f"{base}_e", f"{base}_b")


def lengths(frames: DataFrame, episode: str) -> DataFrame:
    return frames.groupBy(episode).agg(F.count("*").alias("length"))


def select_episodes(frames: DataFrame, episode: str, chosen: list[int]) -> DataFrame:
    """Frames of the chosen episodes; the list becomes a pushed filter, or prunes partitions of that column."""
    return frames.filter(F.col(episode).isin(chosen))


def exclude(frames: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Frames whose key is not among ``excluded``."""
    return frames.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def exclusion_audit(frames: DataFrame, excluded: DataFrame, episode: str) -> DataFrame:
    """Each excluded number with how often it is listed and whether there is such an episode."""
    listed = excluded.groupBy(episode).agg(F.count("*").alias("listed"))
    present = frames.select(episode).distinct().withColumn("present", F.lit(True))
    return listed.join(present, episode, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def check_count(frames: DataFrame, episode: str, expected: Column) -> DataFrame:
    """One row: episodes, frames, expected, matches."""
    found = frames.agg(F.countDistinct(episode).alias("episodes"), F.count("*").alias("frames"))
    return found.withColumn("expected", expected).withColumn("matches", F.col("episodes") == F.col("expected"))


def require_count(frames: DataFrame, episode: str, expected: int) -> DataFrame:
    """Fails when the number of episodes has drifted."""
    told = check_count(frames, episode, F.lit(expected))
    message = F.concat(F.lit(f"expected {expected} episodes, found "), F.col("episodes").cast("string"))
    return told.withColumn("matches", F.when(F.col("matches"), True).otherwise(F.raise_error(message).cast("boolean")))


def offsets(frames: DataFrame, episode: str, dataset: str | None = None, fan: int = 4096) -> DataFrame:
    """Each episode's first and past-the-last row when episodes lie end to end, datasets one after another.

    Episodes are summed ``fan`` numbers at a time; only the sums of those groups are put in one order.
    """
    parts = [dataset] if dataset else []
    sizes = frames.groupBy(*parts, episode).agg(F.count("*").alias("length"))
    sizes = sizes.withColumn("__group", F.floor(F.col(episode) / fan))
    group = [*parts, "__group"]
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy(*group).agg(F.sum("length").alias("n"))
    base = totals.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.sum("length").over(Window.partitionBy(*group).orderBy(episode).rowsBetween(Window.unboundedPreceding, 0))
    out = sizes.withColumn("__end", inside).join(base, group)
    end = F.col("__base") + F.col("__end")
    return out.select(*parts, episode, "length", end.alias("end"), (end - F.col("length")).alias("begin"))


def route(places: DataFrame, place: str, sizes: DataFrame, dataset: str, length: str = "length", few: int = 10_000) -> DataFrame:
    """``places`` (rows over all datasets laid end to end) with dataset and local_row; places beyond the end are left out.

    ``sizes`` has one row a dataset, which is put in order in one task.  It is broadcast while datasets are at most ``few``; more
    are met as intervals.
    """
    before = F.sum(length).over(Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, -1))
    begin = sizes.select(dataset, F.coalesce(before, F.lit(0)).alias("__begin"), F.col(length).alias("__length"))
    if sizes.count() > few:
        (end,) = unused(places, "place_end")
        spans = begin.filter("__length > 0").withColumn("__upto", F.col("__begin") + F.col("__length"))
        met = overlaps(places.withColumn(end, F.col(place)), spans, None, (place, end), ("__begin", "__upto")).drop(end, "__upto")
    else:
        inside = (F.col(place) >= F.col("__begin")) & (F.col(place) < F.col("__begin") + F.col("__length"))
        met = places.join(F.broadcast(begin), inside)
    return met.withColumn("local_row", F.col(place) - F.col("__begin")).drop("__begin", "__length")


def one_rate(datasets: DataFrame, path: str, fps: str) -> DataFrame:
    """One row: datasets, whether all have one fps, whether the last parts of their paths differ."""
    name = F.element_at(F.split(path, "/"), -1)
    return datasets.agg(
        F.count("*").alias("datasets"), (F.countDistinct(fps) <= 1).alias("one_fps"), (F.countDistinct(name) == F.count("*")).alias("names_differ")
    )


def split(episodes: list[int], share: float, seed: int = 42) -> tuple[list[int], list[int]]:
    """Training and held-out episodes: a seeded shuffle of the list, cut at ``int(n * (1 - share))``.

    A share below 1e-6 trains on all, in order.
    """
    if share < 1e-6:
        return list(episodes), []
    order = list(episodes)
    np.random.default_rng(seed).shuffle(order)
    cut = int(len(order) * (1 - share))
    return order[:cut], order[cut:]


def split_table(rows: DataFrame, episode: str, share: float, seed: int = 42) -> DataFrame:
    """episode, part ("train" or "held") of all episodes of a table: its seeded order cut at ``int(n * (1 - share))``."""
    placed = epoch_order(rows.select(episode).distinct(), episode, seed, 0)
    n = placed.agg(F.count("*").alias("__n"))
    first = F.floor(F.col("__n") * (1 - share)) if share >= 1e-6 else F.col("__n")
    told = placed.crossJoin(F.broadcast(n))  # one row
    return told.select(episode, F.when(F.col("place") < first, "train").otherwise("held").alias("part"))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, skip: int = 0) -> DataFrame:
    """``rows`` with their place in the permutation by md5 of seed + epoch and key, less the first ``skip`` places.

    Places are counted within ranges of the hash and ranges are laid end to end, so no task orders all rows.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")).cast("binary")))
    ranged = hashed.withColumn("__r", F.substring("__h", 1, 3))
    inner = F.row_number().over(Window.partitionBy("__r").orderBy("__h", key))
    sizes = ranged.groupBy("__r").agg(F.count("*").alias("__n"))  # at most 4096 rows
    before = F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("__r", F.coalesce(before, F.lit(0)).alias("__base"))
    placed = ranged.withColumn("__i", inner).join(F.broadcast(base), "__r")
    placed = placed.withColumn("place", F.col("__base") + F.col("__i") - 1).filter(F.col("place") >= skip)
    return placed.drop("__h", "__r", "__i", "__base")


def even_places(n: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """Places of an evenly spaced sample of ``n`` rows: n**power of them, within bounds, halves rounded to even."""
    wanted = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.pow(n.cast("double"), power)).cast("int")))
    count = F.least(wanted.cast("long"), n)
    step = F.when(count > 1, (n - 1) / (count - 1).cast("double")).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: F.bround(k * step).cast("long"))


def shard(rows: DataFrame, place: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank`` on."""
    return rows.filter(F.pmod(F.col(place), F.lit(world)) == rank)


def batches(rows: DataFrame, place: str, size: int) -> DataFrame:
    """``rows`` with the number of their batch and the place in it."""
    return rows.withColumns({"batch": F.floor(F.col(place) / size), "in_batch": F.pmod(F.col(place), F.lit(size))})
