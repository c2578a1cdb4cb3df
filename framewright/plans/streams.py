"""Queries over what comes in batches, over lines that can't be read, and over samples that can't be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import episodes, redraw, temporal
from framewright.plans.registry import FRAMES, frames, query, rounded, table
from framewright.sources import datasets, versions
from framewright.storage import materialize, new_path
from framewright.streaming import buffer, running, sessions

PLACED = f"""{FRAMES}, placed AS (SELECT *, row_number() OVER (ORDER BY user_id, frame_index) - 1 AS place FROM frames)"""
_REDRAWN = """, tried AS (
  SELECT s.place, k.k, CAST('0x' || left(md5({seed} || ':' || s.place || ':' || k.k), 15) AS BIGINT) % (SELECT count(*) FROM s) AS found
  FROM s CROSS JOIN range(1, {upto}) k(k) WHERE NOT s.ok),
first AS (SELECT t.place, min(t.k) AS k, arg_min(t.found, t.k) AS found FROM tried t JOIN s ON s.place = t.found AND s.ok GROUP BY t.place),
drawn AS (SELECT s.place, CASE WHEN s.ok THEN s.place ELSE f.found END AS drawn,
  CAST(CASE WHEN s.ok THEN 0 ELSE coalesce(f.k, {tries}) END AS INT) AS tries_made,
  CASE WHEN s.ok THEN s.place ELSE coalesce(f.found, l.found) END AS last
FROM s LEFT JOIN first f ON f.place = s.place LEFT JOIN tried l ON l.place = s.place AND l.k = {tries})
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their place when all episodes lie end to end."""
    rows = frames(spark, sf_dir)
    begin = episodes.offsets(rows, "user_id").select("user_id", "begin")
    return rows.join(begin, "user_id").withColumn("place", F.col("begin") + F.col("frame_index")).drop("begin")


@query(
    f"WITH {PLACED}, s AS (SELECT place, frame_index >= 20 AND frame_index + 20 < n AS ok FROM placed)"
    + _REDRAWN.format(seed="11", upto=4, tries=3)
    + "SELECT * FROM drawn"
)
def redraw_padded(spark, sf_dir):
    """Samples whose window of 41 frames is padded (more than half are) draw another, three times at most."""
    rows = temporal.with_padding(_placed(spark, sf_dir), [-20, 0, 20], "user_id")
    return redraw.redraw(rows.withColumn("ok", ~F.col("has_pad")), tries=3, seed=11)


_LINES = f"""{PLACED}, lines AS (
  SELECT event_id, place, '{{"place":' || place || ',"user_id":' || user_id || ',"channel":' || CAST(channel AS BIGINT) || '}}' AS whole FROM placed),
told AS (
  SELECT event_id, place, CASE WHEN event_id % 7 = 3 THEN left(whole, length(whole) - 4)
    WHEN event_id % 11 = 5 THEN replace(whole, '"channel":', '"channel":"n/a",  "was":')
    WHEN event_id % 13 = 1 THEN replace(whole, '"user_id"', '"user"') ELSE whole END AS line,
    CASE WHEN event_id % 7 = 3 OR event_id % 11 = 5 THEN 'not readable' WHEN event_id % 13 = 1 THEN 'lacks user_id' END AS fault
  FROM lines)"""


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """Frames as JSON lines: some cut off, some with a field of another kind, some without a field."""
    whole = F.to_json(F.struct("place", "user_id", F.col("channel").cast("long").alias("channel")))
    e = F.col("event_id")
    kinds = F.when(e % 7 == 3, F.substring(whole, F.lit(1), F.char_length(whole) - 4))
    kinds = kinds.when(e % 11 == 5, F.replace(whole, F.lit('"channel":'), F.lit('"channel":"n/a",  "was":')))
    kinds = kinds.when(e % 13 == 1, F.replace(whole, F.lit('"user_id"'), F.lit('"user"'))).otherwise(whole)
    path = new_path(spark, "lines")
    _placed(spark, sf_dir).select(kinds.alias("value")).write.text(path)
    return path


def _read_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return datasets.read_apart(spark, _lines(spark, sf_dir), "place long, user_id long, channel long", ["place", "user_id"])


@query(f"WITH {_LINES} SELECT line, fault FROM told WHERE fault IS NOT NULL")
def quarantined_lines(spark, sf_dir):
    return _read_lines(spark, sf_dir)[1].select("line", "fault")


@query(f"WITH {_LINES}, s AS (SELECT place, fault IS NULL AS ok FROM told)" + _REDRAWN.format(seed="0", upto=6, tries=5) + "SELECT * FROM drawn")
def redraw_unreadable(spark, sf_dir):
    """Every place is served: by its own line if that can be read, else by that of another."""
    read = _read_lines(spark, sf_dir)[0].select("place", F.lit(True).alias("ok"))
    total = table(spark, sf_dir, "events").count()
    return redraw.redraw(spark.range(total).withColumnRenamed("id", "place").join(read, "place", "left"))


@query(
    f"WITH {PLACED}, s AS (SELECT place, value, frame_index >= 20 AND frame_index + 20 < n AS ok FROM placed)"
    + _REDRAWN.format(seed="11", upto=4, tries=3)
    + "SELECT d.place, d.last AS served_from, round(s.value, 6) AS value FROM drawn d JOIN s ON s.place = d.last"
)
def serve_redrawn(spark, sf_dir):
    """The values that are served: where no try helped, those of the last one tried, padded as they are."""
    rows = temporal.with_padding(_placed(spark, sf_dir), [-20, 0, 20], "user_id").withColumn("ok", ~F.col("has_pad"))
    served = redraw.serve(rows.select("place", "value"), redraw.redraw(rows, tries=3, seed=11), by="last")
    return rounded(served, "value")


def _delivered(spark: SparkSession, rows: DataFrame, part: str, parts: int) -> str:
    """``rows`` as files that come one after another: those of part 0 first."""
    path = new_path(spark, "delivered")
    held = materialize(rows, "to-deliver")
    for k in range(parts):
        held.filter(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str, like: DataFrame, part: str) -> DataFrame:
    return spark.readStream.schema(like.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _running(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """``value`` of all events in five batches, the last of which is delivered twice."""
    rows = table(spark, sf_dir, "events").select(key, "value", (F.col("event_id") % 5).alias("part"))
    path, root, checkpoint = _delivered(spark, rows, "part", 5), new_path(spark, "running"), new_path(spark, "running-checkpoint")
    stream = _stream(spark, path, rows, "part")
    running.keep_statistics(stream, [key], "value", root, checkpoint).awaitTermination()
    last = versions.latest(spark, root)
    last_rows = rows.filter("part = 4").drop("part")
    running.absorb(running.moments(last_rows, [key], "value"), root, last, [key])
    return running.statistics(spark, root)


@query(
    "SELECT event_type, count(value) AS \"count\", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS \"min\", "
    "round(max(value), 6) AS \"max\" FROM events GROUP BY event_type"
)
def running_statistics(spark, sf_dir):
    return rounded(_running(spark, sf_dir, "event_type"), "mean", "std", "min", "max")


@query("SELECT count(DISTINCT user_id) AS total_episodes, CAST(count(value) AS BIGINT) AS total_frames, '0:' || count(DISTINCT user_id) AS split_train FROM events")
def running_counters(spark, sf_dir):
    return running.counters(_running(spark, sf_dir, "user_id"), "user_id")


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index FROM events)
SELECT user_id AS episode, frame_index, round(frame_index / 30.0, 6) AS seconds, event_id AS order_key, event_type AS task,
  row_number() OVER (ORDER BY user_id, frame_index) - 1 AS "index", CASE WHEN user_id % 2 = 0 THEN 'end' ELSE 'idle' END AS ended_by FROM f"""
)
def episode_buffer(spark, sf_dir):
    """Frames come by days, mixed over episodes; half of the episodes are ended by a row, the others by a day without frames."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    kept = events.select(F.col("user_id").alias("episode"), at.alias("at"), F.col("event_id").alias("order_key"), F.col("event_type").alias("task"))
    kept = kept.withColumns({"ends": F.lit(False), "part": F.floor((F.dayofmonth("at") - 1) / 8).cast("int")})
    newest = kept.agg(F.max("at")).first()[0]
    last = kept.filter("episode % 2 = 0").groupBy("episode").agg(F.lit(newest).alias("at"), (F.max("order_key") + 1).alias("order_key"))
    last = last.withColumns({"task": F.lit(None).cast("string"), "ends": F.lit(True), "part": F.lit(4)})
    over = last.limit(1).withColumns({"episode": F.lit(-1).cast("long"), "at": F.lit(newest) + F.expr("INTERVAL 400 DAYS"), "part": F.lit(5)})
    rows = kept.unionByName(last).unionByName(over)
    path = _delivered(spark, rows, "part", 6)
    with buffer.rocks(spark):
        made = buffer.episodes(_stream(spark, path, rows, "part"), 30.0, idle="40 days")
        frames_ = sessions.run_to_end(made, new_path(spark, "committed"), new_path(spark, "buffer-checkpoint"))
    begin = episodes.offsets(frames_, "episode").select("episode", "begin")
    placed = frames_.join(begin, "episode").withColumn("index", F.col("begin") + F.col("frame_index")).drop("begin")
    return rounded(placed, "seconds")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of time, in three files, then one row far ahead, which lets the watermark pass all windows."""
    rows = _timed(spark, sf_dir).withColumn("part", F.floor((F.dayofmonth("at") - 1) / 11).cast("int"))
    newest = rows.agg(F.max("at")).first()[0]
    ahead = rows.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "event_type": F.lit("none"), "at": F.lit(newest) + F.expr("INTERVAL 30 DAYS"), "part": F.lit(3)})
    rows = rows.unionByName(ahead)
    return _stream(spark, _delivered(spark, rows, "part", 4), rows, "part")


@query(
    """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE AS goes_on FROM events),
n AS (SELECT *, count(*) FILTER (WHERE goes_on IS NOT TRUE) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS "rows", round(sum(value), 4) AS total
FROM n GROUP BY user_id, session"""
)
def event_sessions(spark, sf_dir):
    made = sessions.sessions(_flushed(spark, sf_dir), "user_id", "at", "30 minutes", "1 hour", F.sum("value").alias("total"))
    told = sessions.run_to_end(made, new_path(spark, "sessions"), new_path(spark, "sessions-checkpoint")).filter("user_id >= 0")
    return rounded(told.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "rows", "total"), "total", places=4)


@query(
    """WITH h AS (SELECT *, unnest([0, 1]) AS back FROM events)
SELECT event_type, epoch_us(time_bucket(INTERVAL 3 HOUR, ts) - back * INTERVAL 3 HOUR) AS begin_us, count(*) AS "rows", round(avg(value), 6) AS mean
FROM h GROUP BY ALL"""
)
def hop_windows(spark, sf_dir):
    """Windows of six hours every three."""
    made = sessions.tumbling(_flushed(spark, sf_dir), "event_type", "at", "6 hours", "1 hour", F.avg("value").alias("mean"), step="3 hours")
    told = sessions.run_to_end(made, new_path(spark, "windows"), new_path(spark, "windows-checkpoint")).filter("event_type <> 'none'")
    return rounded(told.select("event_type", F.unix_micros("begin").alias("begin_us"), "rows", "mean"), "mean")


@query(
    """WITH b AS (SELECT *, (day(ts) - 1) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM events),
m AS (SELECT batch, max(ts) AS newest FROM b GROUP BY batch)
SELECT b.event_id, b.batch, b.ts < (SELECT max(newest) FROM m WHERE m.batch < b.batch) - INTERVAL 3 DAY IS TRUE AS late FROM b"""
)
def late_events(spark, sf_dir):
    """One event in ten comes a batch (eight days) late; three days are waited for."""
    rows = _timed(spark, sf_dir).withColumn("part", (F.floor((F.dayofmonth("at") - 1) / 8) + (F.col("event_id") % 10 == 0).cast("int")).cast("int"))
    root = new_path(spark, "apart")
    stream = _stream(spark, _delivered(spark, rows, "part", 5), rows, "part")
    sessions.split_late(stream, "at", "3 days", root, new_path(spark, "apart-checkpoint")).awaitTermination()
    late = sessions.late_rows(spark, root).select("event_id", F.col("batch").cast("long"), F.lit(True).alias("late"))
    fine = spark.read.parquet(f"{root}/on_time").select("event_id", F.col("batch").cast("long"), F.lit(False).alias("late"))
    return fine.unionByName(late)
