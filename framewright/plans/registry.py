"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import episodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a user is an episode, in order of time."""
    numbered = episodes.number_frames(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    channel = F.get_json_object("props", "$.k").cast("double").alias("channel")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds")
    return numbered.select("user_id", "frame_index", "event_id", "event_type", "ts", seconds, "value", channel)


#: The same in SQL, as a common table expression.
FRAMES = """frames AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id, event_type, ts,
         epoch_us(ts) / 1e6 AS seconds, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS channel,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles to so many places, for comparison."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})
