"""Queries over long episodes cut into ranges, over texts in several roles, and checks of saved episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import text as fx
from framewright.operators import episodes, halo, lookups
from framewright.plans.registry import FRAMES, frames, query, rounded, table
from framewright.plans.time import _DELTAS, CHUNKS
from framewright.sources import datasets, schema
from framewright.storage import new_path

SPAN = 16


@query(_DELTAS.format(frames=FRAMES, deltas="-6, -3, 0, 2"))
def delta_gather_in_ranges(spark, sf_dir):
    """Offset windows over ranges of 16 frames with halos: the same rows as over whole episodes."""
    deltas = [-6, -3, 0, 2]
    got = halo.delta_window(frames(spark, sf_dir), "value", deltas, "user_id", span=SPAN)
    zipped = F.arrays_zip(F.array(*map(F.lit, deltas)).alias("delta"), F.col("window").alias("v"), F.col("is_pad").alias("p"))
    each = got.select("user_id", "frame_index", F.explode(zipped).alias("z"))
    return rounded(each.select("user_id", "frame_index", F.col("z.delta").alias("delta"), F.col("z.p").alias("is_pad"), F.col("z.v").alias("value")), "value")


@query(f'WITH {CHUNKS} SELECT user_id, frame_index, "offset", round(x, 6) AS x FROM chunks')
def action_chunks_in_ranges(spark, sf_dir):
    got = halo.sliding_window(frames(spark, sf_dir), "value", 4, "user_id", span=SPAN)
    return rounded(got.select("user_id", "frame_index", F.posexplode("chunk").alias("offset", "x")), "x")


@query(
    f"WITH {FRAMES}, s AS (SELECT *, seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY frame_index) AS since FROM frames) "
    "SELECT user_id, frame_index, round(since, 4) AS since FROM s WHERE abs(since - 3600) > 1800"
)
def gaps_in_ranges(spark, sf_dir):
    found = halo.irregular_steps(frames(spark, sf_dir), "seconds", 3600.0, 1800.0, "user_id", span=SPAN)
    return rounded(found.select("user_id", "frame_index", "since"), "since", places=4)


@query(f"WITH {FRAMES} SELECT user_id, frame_index, event_id FROM frames")
def frames_numbered_in_blocks(spark, sf_dir):
    """Frames numbered within days, and days laid end to end."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", seconds)
    return episodes.number_frames_in_blocks(rows, "user_id", "seconds", 86_400.0, "event_id").select("user_id", "frame_index", "event_id")


_ROLES = """r AS (SELECT event_id, 'do ' || event_type AS coarse_task, event_type || ' ' || user_id % 7 AS task,
  CASE WHEN value > 20 THEN 'good' WHEN value > 5 THEN 'fair' END AS coarse_quality, 'rated ' || CAST(floor(value) AS BIGINT) % 9 AS quality FROM events),
k AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS i FROM (SELECT DISTINCT coarse_task AS task FROM r)),
n AS (SELECT t, row_number() OVER (ORDER BY t) + (SELECT max(i) FROM k) AS i FROM (
  SELECT task AS t FROM r UNION SELECT coarse_quality FROM r WHERE coarse_quality IS NOT NULL UNION SELECT quality FROM r) u WHERE t NOT IN (SELECT task FROM k)),
a AS (SELECT task, i FROM k UNION ALL SELECT t, i FROM n)"""


@query(
    f"""WITH {_ROLES} SELECT r.event_id, w.i AS coarse_task_index, x.i AS task_index, y.i AS coarse_quality_index, z.i AS quality_index FROM r
LEFT JOIN a w ON w.task = r.coarse_task LEFT JOIN a x ON x.task = r.task LEFT JOIN a y ON y.task = r.coarse_quality LEFT JOIN a z ON z.task = r.quality"""
)
def four_task_indices(spark, sf_dir):
    """The four task texts of a frame, with the indices that they get when it is saved; some tasks are known before."""
    value = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("do "), "event_type").alias("coarse_task"),
        F.concat_ws(" ", "event_type", F.col("user_id") % 7).alias("task"),
        F.when(value > 20, "good").when(value > 5, "fair").alias("coarse_quality"),
        F.concat(F.lit("rated "), F.floor(value) % 9).alias("quality"),
    )
    none = spark.createDataFrame([], "task string, task_index long")
    known = lookups.with_new_keys(none, rows.select(F.col("coarse_task").alias("task")), "task", "task_index")
    names = {c: f"{c}_index" for c in ("coarse_task", "task", "coarse_quality", "quality")}
    told, _ = lookups.role_indices(rows, known, names, "task", "task_index")
    return told.select("event_id", *names.values())


@query(
    "SELECT user_id AS episode_index, 'value' AS feature, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS \"count\" FROM events WHERE user_id % 3 = 1 GROUP BY user_id"
)
def stats_of_chosen_episodes(spark, sf_dir):
    """Episode statistics written and read back; those of the chosen episodes are looked up."""
    events = table(spark, sf_dir, "events")
    one = lambda c: F.array(c)
    made = events.groupBy(F.col("user_id").alias("episode_index")).agg(
        one(F.min("value")).alias("min"), one(F.max("value")).alias("max"), one(F.avg("value")).alias("mean"), one(F.stddev_pop("value")).alias("std"), one(F.count("*")).alias("count")
    )
    root = new_path(spark, "episode-stats")
    datasets.write_episode_stats(made.withColumn("feature", F.lit("value")), root)
    chosen = events.filter("user_id % 3 = 1").select(F.col("user_id").alias("episode_index")).distinct()
    found = datasets.read_episode_stats(spark, root).join(chosen, "episode_index", "left_semi")
    return rounded(found.select("episode_index", "feature", F.element_at("mean", 1).alias("mean"), F.element_at("count", 1).alias("count")), "mean")


@query(
    """SELECT doc_id, md5(list_aggregate(list_sort(['text:' || length(text), 'lang:' || length(lang), 'source:' || length(source)]), 'string_agg', ',')) AS shapes FROM documents"""
)
def shape_hashes(spark, sf_dir):
    entry = lambda c: F.concat_ws(":", F.lit(c), F.char_length(c))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", fx.shape_hash(F.array(*map(entry, ("text", "lang", "source")))).alias("shapes"))


@query(
    "SELECT page_id, trim('x' || replace(replace(replace(replace(replace(replace(left(url, 40), '&', '+'), '<', '('), '>', ')'), '\"', '~'), ';', ','), '#', '!') || ' & < >') AS cleaned FROM pages"
)
def resolved_references(spark, sf_dir):
    """Character references, some of them written twice over, resolved."""
    plain = F.translate(F.substring("url", 1, 40), '&<>";#', "+()~,!")
    return table(spark, sf_dir, "pages").select("page_id", fx.basic_clean(F.concat(F.lit("x"), plain, F.lit(" &amp;amp; &lt; &amp;gt; "))).alias("cleaned"))


@query("SELECT 0 AS \"rows\", 4 AS columns, 'observation.images.top' AS videos WHERE (SELECT count(*) FROM events) > 0")
def empty_dataset(spark, sf_dir):
    """A dataset that is begun with the table of declared features, and no frames yet."""
    joints = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    declared = schema.joint_features(joints, {"top": (224, 320, 3)})
    path = new_path(spark, "begun")
    datasets.empty_table(spark, schema.table_schema(declared)).write.parquet(path)
    back = spark.read.parquet(path)
    videos = ",".join(schema.names_of(declared, "video"))
    named = len([c for c in back.columns if c not in ("index", "task_index")])
    return back.agg(F.count("*").cast("int").alias("rows")).select("rows", F.lit(named).alias("columns"), F.lit(videos).alias("videos"))
