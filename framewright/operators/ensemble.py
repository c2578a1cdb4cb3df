"""Overlapping predictions: means per step, and queues of re-planned chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_chunks(chunks: DataFrame, keys: list[str], start: str, chunk: str) -> DataFrame:
    """keys, start, offset, step, x: a row per prediction."""
    out = chunks.select(*keys, start, F.posexplode(chunk).alias("offset", "x"))
    return out.withColumn("step", F.col(start) + F.col("offset"))


def ensemble_mean(chunks: DataFrame, keys: list[str], start: str, chunk: str) -> DataFrame:
    """keys, step, mean, votes: all predictions of a step, averaged; a shuffle of partial sums."""
    rows = explode_chunks(chunks, keys, start, chunk)
    return rows.groupBy(*keys, "step").agg(F.avg("x").alias("mean"), F.count("*").alias("votes"))


def replan_queue(chunks: DataFrame, keys: list[str], start: str, chunk: str, replan: int) -> DataFrame:
    """keys, step, x: chunks made every ``replan`` steps, of which as many predictions are used."""
    heads = chunks.filter(F.col(start) % replan == 0).withColumn(chunk, F.slice(chunk, 1, replan))
    return explode_chunks(heads, keys, start, chunk).select(*keys, "step", "x")


def replan_ensemble(chunks: DataFrame, keys: list[str], start: str, chunk: str, replan: int) -> DataFrame:
    """The queue with the means of the chunks made so far: a step counts the chunks begun up to its own re-plan."""
    rows = explode_chunks(chunks.filter(F.col(start) % replan == 0), keys, start, chunk)
    made = F.floor(F.col("step") / replan) * replan
    return rows.filter(F.col(start) <= made).groupBy(*keys, "step").agg(F.avg("x").alias("mean"), F.count("*").alias("votes"))
