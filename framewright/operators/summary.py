"""Success logs as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rollup(results: DataFrame, suite: str, trials: str, successes: str, seconds: str) -> DataFrame:
    """Per suite: tasks, trials, successes, success_rate, average and largest task time."""
    return results.groupBy(suite).agg(*_measures(trials, successes, seconds))


def overall(results: DataFrame, trials: str, successes: str, seconds: str) -> DataFrame:
    return results.agg(*_measures(trials, successes, seconds))


def _measures(trials: str, successes: str, seconds: str) -> list[Column]:
    return [
        F.count("*").alias("tasks"),
        F.sum(trials).alias("trials"),
        F.sum(successes).alias("successes"),
        guarded(F.sum(successes).cast("double"), F.sum(trials)).alias("success_rate"),
        guarded(F.sum(seconds).cast("double"), F.count("*")).alias("average_task_time_seconds"),
        F.max(seconds).alias("max_task_time_seconds"),
    ]


def summary_document(results: DataFrame, suite: str, trials: str, successes: str, seconds: str) -> DataFrame:
    """One row: ``suites``, a struct each in order of name, and ``overall``; one pass over the results."""
    each = results.rollup(suite).agg(F.grouping(suite).alias("__all"), *_measures(trials, successes, seconds))
    row = F.struct(*[c for c in each.columns if c != "__all"])
    return each.agg(
        F.sort_array(F.collect_list(F.when(F.col("__all") == 0, row))).alias("suites"),
        F.first(F.when(F.col("__all") == 1, row), ignorenulls=True).alias("overall"),
    )


def failed_tasks(rates: DataFrame, task: str, *phases: str) -> DataFrame:
    """task, failed: the tasks that lack a rate, with the phases that lack it in the order given."""
    lacks = F.filter(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in phases]), lambda p: p.isNotNull())
    return rates.select(task, lacks.alias("failed")).filter(F.size("failed") > 0)


def suite_rank(suite: Column, order: list[str]) -> Column:
    """A suite's place in the fixed order; unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, order)), suite)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def known_suites(rows: DataFrame, suite: str, order: list[str]) -> DataFrame:
    """The rows of the suites in the order; others count only in ``overall``."""
    return rows.filter(F.col(suite).isin(*order))


def episode_lists(trials: DataFrame, keys: list[str], number: str, success: str) -> DataFrame:
    """Counts and sorted lists of episodes that succeeded and failed."""
    ok = F.col(success)
    return trials.groupBy(*keys).agg(
        F.count("*").alias("total_episodes"),
        F.count_if(ok).alias("successes"),
        F.sort_array(F.collect_list(F.when(ok, F.col(number)))).alias("success_episodes"),
        F.sort_array(F.collect_list(F.when(~ok, F.col(number)))).alias("failure_episodes"),
    )


def last_number(lines: DataFrame, key: str, line: str, place: str) -> DataFrame:
    """The last line of each key that reads as a number."""
    value = F.trim(F.col(line)).try_cast("double")
    return lines.withColumn("__v", value).filter(F.col("__v").isNotNull()).groupBy(key).agg(F.max_by("__v", place).alias("last_value"))


def latest(files: DataFrame, key: str, path: str, time: str, since: Column | None = None) -> DataFrame:
    """The latest file of each key, not older than ``since``."""
    fresh = files if since is None else files.filter(F.col(time) >= since)
    return fresh.groupBy(key).agg(F.max_by(path, F.struct(time, path)).alias(path))
