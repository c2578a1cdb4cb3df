"""Statistics that are kept up to date as batches come, each batch counting once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.sources import versions

MOMENTS = ["count", "mean", "m2", "min", "max"]


def moments(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, count, mean, m2 (sum of squared distances from the mean), min, max of what is not null; keys of nulls alone are left out."""
    value = F.col(x).cast("double")
    found = rows.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return found.filter(F.col("count") > 0)


def merge_moments(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of both tables together, a row a key in each; the mean is shifted, so no large squares are subtracted."""
    a, b = (t.select(*keys, F.struct(*MOMENTS).alias(name)) for t, name in ((one, "a"), (other, "b")))
    same = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    a, b = (t.withColumnsRenamed({k: f"{name}_{k}" for k in keys}) for t, name in ((a, "a"), (b, "b")))
    both = a.join(b, same, "full")
    n_a, n_b = (F.coalesce(F.col(f"{s}.count"), F.lit(0)) for s in "ab")
    n, shift = n_a + n_b, F.col("b.mean") - F.col("a.mean")
    only = lambda name, joined: F.when(F.col("a").isNull(), F.col(f"b.{name}")).when(F.col("b").isNull(), F.col(f"a.{name}")).otherwise(joined)
    return both.select(
        *[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys],
        n.alias("count"),
        only("mean", F.col("a.mean") + shift * n_b / n).alias("mean"),
        only("m2", F.col("a.m2") + F.col("b.m2") + shift * shift * n_a * n_b / n).alias("m2"),
        F.least("a.min", "b.min").alias("min"),
        F.greatest("a.max", "b.max").alias("max"),
    )


def absorb(part: DataFrame, root: str, batch_id: int, keys: list[str]) -> bool:
    """Merge the moments of one batch into the table at ``root``; False, and nothing changes, if a batch of that number counts already."""
    spark = part.sparkSession
    last = versions.latest(spark, root)
    if last is not None and batch_id <= last:
        return False
    merged = part if last is None else merge_moments(versions.read(spark, root, last), part, keys)
    done = versions.commit(merged, root, batch_id)
    versions.prune(spark, root)
    return done


def keep_statistics(stream: DataFrame, keys: list[str], x: str, root: str, checkpoint: str, start: Callable = lambda w: w.trigger(availableNow=True)) -> StreamingQuery:
    """A running query that merges each batch of ``stream`` into the table at ``root``.

    The table is one row a key, and is written anew with each batch that counts; the last two versions stay.  A batch that the
    engine delivers again after a failure has the same number, so it is passed over.  ``root`` belongs to ``checkpoint``: numbers
    start anew with a new one.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        absorb(moments(batch, keys, x), root, batch_id, keys)

    return start(stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)).start()


def statistics(spark, root: str) -> DataFrame:
    """The table as it is now: keys, count, mean, std (population), min, max."""
    return versions.read(spark, root).withColumn("std", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("count"))).drop("m2")


def counters(stats: DataFrame, episode: str) -> DataFrame:
    """One row: total_episodes, total_frames and the split of a dataset whose statistics are kept by episode."""
    total = stats.groupBy(episode).agg(F.max("count").alias("n")).agg(F.count("*").alias("total_episodes"), F.sum("n").alias("total_frames"))
    return total.withColumn("split_train", F.concat(F.lit("0:"), F.col("total_episodes")))
