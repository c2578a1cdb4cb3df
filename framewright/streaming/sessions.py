"""Windows over event time: a watermark bounds the state, and what comes too late is kept apart instead of lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.sources import versions


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str, *measures: Column) -> DataFrame:
    """key, begin, end (of the last row, plus the gap), rows and the measures of runs of rows that are less than ``gap`` apart.

    A session is out once the watermark, ``delay`` behind the newest row, has passed its end; then its state goes.
    """
    window = F.session_window(time, gap)
    found = stream.withWatermark(time, delay).groupBy(key, window.alias("w")).agg(F.count("*").alias("rows"), *measures)
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (key, "w")])


def tumbling(stream: DataFrame, key: str, time: str, width: str, delay: str, *measures: Column, step: str | None = None) -> DataFrame:
    """key, begin, end, rows and the measures of windows of ``width`` (every ``step``, if they hop)."""
    found = stream.withWatermark(time, delay).groupBy(key, F.window(time, width, step).alias("w")).agg(F.count("*").alias("rows"), *measures)
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (key, "w")])


def split_late(stream: DataFrame, time: str, delay: str, root: str, checkpoint: str) -> StreamingQuery:
    """A running query that deals the rows of ``stream`` to ``root``/on_time and ``root``/late.

    A row is late if it is more than ``delay`` older than the newest row of the batches before.  That time is kept as a version
    a batch.  A batch that is delivered again replaces what it wrote, by the same watermark, so no row is there twice.
    """
    marks = f"{root}/newest"

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions.finished(spark, marks) if v < batch_id]
        newest = versions.read(spark, marks, max(before)).first()[0] if before else None
        limit = F.lit(newest) - F.expr(f"INTERVAL {delay}") if newest is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col(time) < limit, F.lit(False))
        for part, chosen in (("on_time", ~late), ("late", late)):
            batch.filter(chosen).write.mode("overwrite").parquet(f"{root}/{part}/batch={batch_id}")
        seen = batch.agg(F.greatest(F.max(time), F.lit(newest).cast("timestamp")).alias("newest"))
        versions.commit(seen, marks, batch_id)
        versions.prune(spark, marks, keep=3)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    return spark.read.parquet(f"{root}/late")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that an appending stream has to give, as a table."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
