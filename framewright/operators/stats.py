"""Two families of statistics: pooled by count, and normaliser statistics that weigh episodes alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, dim, x: one row per element of a vector column."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def feature_stats(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """min, max, mean, population std and count by key."""
    value = F.col(x)
    return rows.groupBy(*keys).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count(value).alias("count"),
    )


def merge_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact pooled statistics from those of parts, by count."""
    n = F.col("count")
    moments = parts.groupBy(*keys).agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum(F.col("mean") * n).alias("s1"),
        F.sum((F.pow("std", F.lit(2)) + F.pow("mean", F.lit(2))) * n).alias("s2"),
        F.sum(n).alias("count"),
    )
    mean = F.col("s1") / F.col("count")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("count") - mean * mean, F.lit(0.0)))
    return moments.select(*keys, "min", "max", mean.alias("mean"), spread.alias("std"), "count")


def episode_stats(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """min, max, mu, var (sample), exact q01 and q99 by key; a single row's variance is null and is passed over later."""
    value = F.col(x)
    return rows.groupBy(*keys).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mu"),
        F.var_samp(value).alias("var"),
        F.percentile(value, F.lit(0.01)).alias("q01"),
        F.percentile(value, F.lit(0.99)).alias("q99"),
    )


def merge_episodes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Normaliser statistics: episodes weigh alike, quantiles are an envelope.

    mean of the means; std is the root of the mean of var + (mu - mean)**2, that is of mean var plus the
    population variance of the means, over the parts that have a variance.
    """
    has = F.col("var").isNotNull()
    mean_of = F.avg(F.when(has, F.col("mu")))
    merged = parts.groupBy(*keys).agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.avg("mu").alias("mean"),
        F.avg("var").alias("v"),
        F.var_pop(F.when(has, F.col("mu"))).alias("between"),
        mean_of.alias("seen"),
        F.min("q01").alias("q01"),
        F.max("q99").alias("q99"),
    )
    spread = F.sqrt(F.col("v") + F.col("between") + F.pow(F.col("seen") - F.col("mean"), F.lit(2)))
    return merged.select(*keys, "min", "max", "mean", spread.alias("std"), "q01", "q99")


def floored_std(x: Column, floor: float = 1e-3) -> Column:
    """Sample standard deviation, not below the floor."""
    return F.greatest(F.stddev_samp(x), F.lit(floor))


def masked_mean(x: Column, padded: Column) -> Column:
    """Mean of what is not padded; 0 if all is."""
    return F.sum(F.when(~padded, x).otherwise(0.0)) / F.greatest(F.count_if(~padded), F.lit(1))


def weighted_mean(x: Column, weight: Column, keep: Column) -> Column:
    """Mean of x * weight over the rows to keep; 0 if there are none."""
    return F.sum(F.when(keep, x * weight).otherwise(0.0)) / F.greatest(F.count_if(keep), F.lit(1))


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def evenly_sampled(rows: DataFrame, keys: list[str], order: list[str], least: int = 100, most: int = 10_000, power: float = 0.75) -> DataFrame:
    """The rows at evenly spaced places of each group in ``order``: n**power of n, within bounds, both ends included."""
    in_group = Window.partitionBy(*keys)
    place = (F.row_number().over(in_group.orderBy(*order)) - 1).cast("double")
    n = F.count(F.lit(1)).over(in_group)
    wanted = F.least(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.pow(n.cast("double"), power)).cast("int"))), n)
    step = F.when(wanted > 1, (n - 1) / (wanted - 1).cast("double")).otherwise(0.0)
    placed = rows.select(*[F.struct("*").alias("row")], place.alias("place"), n.alias("n"), step.alias("step"))
    near = F.floor(F.col("place") / F.col("step"))  # the sample there is this or the next one
    hit = (F.bround(near * F.col("step")) == F.col("place")) | (F.bround((near + 1) * F.col("step")) == F.col("place"))
    return placed.filter(F.when(F.col("step") > 0, hit).otherwise(F.col("place") == 0)).select("row.*")


def channel_stats(rows: DataFrame, keys: list[str], image: str) -> DataFrame:
    """keys, channel, min, max, mean, std, count of images (arrays of channels, of lines, of values), over lines and columns and all rows of a key.

    Each image is reduced where it stands; only a row a channel is summed.  ``count`` is the number of images.
    """
    x = F.posexplode(F.transform(image, lambda c: F.transform(F.flatten(c), lambda v: v.cast("double")))).alias("channel", "x")
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    flat = rows.select(*keys, x).withColumns({"count": F.size("x").cast("long"), "mean": total(F.col("x")) / F.size("x")})
    spread = F.sqrt(total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.col("count"))
    parts = flat.select(*keys, "channel", F.array_min("x").alias("min"), F.array_max("x").alias("max"), "mean", spread.alias("std"), "count")
    images = parts.groupBy(*keys, "channel").agg(F.count("*").alias("images"))
    merged = merge_stats(parts, [*keys, "channel"]).drop("count")
    return merged.join(images, [*keys, "channel"]).withColumnRenamed("images", "count")
