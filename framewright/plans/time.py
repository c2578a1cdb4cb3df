"""Queries over frames in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import ensemble, episodes, temporal, vectors
from framewright.plans.registry import FRAMES, frames, query, rounded, table
from framewright.storage import new_path
from framewright.streaming import ensembler

CHUNKS = f"""{FRAMES}, chunks AS (
  SELECT a.user_id, a.frame_index, j.j AS "offset", b.value AS x, a.frame_index + j.j >= a.n AS pad
  FROM frames a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS j) j
  JOIN frames b ON b.user_id = a.user_id AND b.frame_index = least(a.frame_index + j.j, a.n - 1))"""


def _chunks(spark, sf_dir):
    return temporal.sliding_window(frames(spark, sf_dir), "value", 4, "user_id")


@query(f"WITH {FRAMES} SELECT user_id, frame_index, event_id, round(value, 6) AS value FROM frames")
def scan_frames(spark, sf_dir):
    return rounded(frames(spark, sf_dir).select("user_id", "frame_index", "event_id", "value"), "value")


@query("SELECT user_id, event_id, event_type FROM events WHERE user_id IN (1, 3, 5, 7)")
def episode_prune(spark, sf_dir):
    return episodes.select_episodes(table(spark, sf_dir, "events"), "user_id", [1, 3, 5, 7]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS frames FROM events WHERE user_id NOT IN (0, 2, 4, 11) GROUP BY user_id")
def exclude_episodes(spark, sf_dir):
    out = spark.createDataFrame([(x,) for x in (0, 2, 4, 11, 2)], "user_id long")
    return episodes.lengths(episodes.exclude(table(spark, sf_dir, "events"), out, "user_id"), "user_id").withColumnRenamed("length", "frames")


@query(
    "WITH l AS (SELECT unnest([0, 2, 4, 2, 999999999]) AS user_id) SELECT l.user_id, count(*) AS listed, "
    "l.user_id IN (SELECT user_id FROM events) AS present FROM l GROUP BY l.user_id"
)
def exclusion_audit(spark, sf_dir):
    out = spark.createDataFrame([(x,) for x in (0, 2, 4, 2, 999999999)], "user_id long")
    return episodes.exclusion_audit(table(spark, sf_dir, "events"), out, "user_id")


@query(
    """SELECT count(DISTINCT user_id) AS episodes, count(*) AS frames, max(user_id) + 1 AS expected, count(DISTINCT user_id) = max(user_id) + 1 AS matches
FROM events"""
)
def expected_counts(spark, sf_dir):
    """Episodes are numbered from 0, so there should be one more than the largest number."""
    events = table(spark, sf_dir, "events")
    return episodes.check_count(events, "user_id", F.lit(events.agg(F.max("user_id")).first()[0] + 1))


_DELTAS = """WITH {frames} SELECT a.user_id, a.frame_index, d.d AS delta,
  a.frame_index + d.d < 0 OR a.frame_index + d.d >= a.n AS is_pad, round(b.value, 6) AS value
FROM frames a CROSS JOIN (SELECT unnest([{deltas}]) AS d) d
JOIN frames b ON b.user_id = a.user_id AND b.frame_index = greatest(0, least(a.frame_index + d.d, a.n - 1))"""


@query(_DELTAS.format(frames=FRAMES, deltas="0, 1, 2, 3"))
def delta_gather(spark, sf_dir):
    return rounded(temporal.delta_rows(frames(spark, sf_dir), "value", [0, 1, 2, 3], "user_id"), "value")


@query(_DELTAS.format(frames=FRAMES, deltas="-6, -3, 0"))
def delta_gather_past(spark, sf_dir):
    return rounded(temporal.delta_rows(frames(spark, sf_dir), "value", temporal.window_deltas(3, 3, past=2), "user_id"), "value")


@query(f"WITH {FRAMES} SELECT user_id, frame_index FROM frames WHERE frame_index >= 2 AND frame_index + 5 < n")
def pad_filter(spark, sf_dir):
    return temporal.unpadded(frames(spark, sf_dir), [-2, 0, 5], "user_id").select("user_id", "frame_index")


@query(f'WITH {CHUNKS} SELECT user_id, frame_index, "offset", round(x, 6) AS x FROM chunks')
def action_chunks(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select("user_id", "frame_index", F.posexplode("chunk").alias("offset", "x"))
    return rounded(rows, "x")


@query(
    """WITH l AS (SELECT user_id % 3 AS dataset, user_id, count(*) AS length FROM events GROUP BY ALL)
SELECT dataset, user_id, length, CAST(sum(length) OVER w AS BIGINT) AS "end", CAST(sum(length) OVER w - length AS BIGINT) AS "begin"
FROM l WINDOW w AS (ORDER BY dataset, user_id)"""
)
def offset_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("dataset"), "user_id")
    return episodes.offsets(rows, "user_id", "dataset")


@query(
    f"""WITH {FRAMES}, s AS (SELECT *, seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY frame_index) AS since FROM frames)
SELECT user_id, frame_index, round(since, 3) AS since FROM s WHERE abs(since - 3600.0) > 86400.0"""
)
def gap_check(spark, sf_dir):
    found = temporal.irregular_steps(frames(spark, sf_dir), "seconds", 3600.0, 86400.0, "user_id")
    return found.select("user_id", "frame_index", F.round("since", 3).alias("since"))


@query(
    f"""WITH {FRAMES}, p AS (SELECT DISTINCT user_id, seconds FROM frames WHERE event_type = 'purchase'),
v AS (SELECT user_id, seconds AS found_time FROM frames WHERE event_type = 'view'),
b AS (SELECT p.user_id, p.seconds, v.found_time, abs(p.seconds - v.found_time) AS distance, row_number() OVER (
  PARTITION BY p.user_id, p.seconds ORDER BY abs(p.seconds - v.found_time), v.found_time) AS k
  FROM p JOIN v ON p.user_id = v.user_id AND abs(p.seconds - v.found_time) < 43200.0)
SELECT p.user_id, p.seconds, b.found_time, round(b.distance, 3) AS distance
FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.seconds = p.seconds AND b.k = 1"""
)
def nearest_match(spark, sf_dir):
    f = frames(spark, sf_dir)
    wanted = f.filter("event_type = 'purchase'").select("user_id", "seconds").distinct()
    there = f.filter("event_type = 'view'").select("user_id", "seconds")
    matched = temporal.nearest(wanted, there, "user_id", "seconds", 43200.0)
    return matched.withColumn("distance", F.round("distance", 3))


@query("SELECT conv_id, turn, role FROM conversations WHERE turn % 3 = 0")
def stride_subsample(spark, sf_dir):
    return temporal.strided(table(spark, sf_dir, "conversations"), "turn", 3).select("conv_id", "turn", "role")


@query(
    """SELECT conv_id, CASE WHEN turn = 0 THEN 0 ELSE 1 + (turn - 1) // 4 END AS pooled, bool_and(length(text) < 200) AS is_pad
FROM conversations GROUP BY ALL"""
)
def mask_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("short", F.char_length("text") < 200)
    return temporal.pool_mask(rows, ["conv_id"], "turn", "short", 4)


@query(f'WITH {CHUNKS} SELECT user_id, frame_index + "offset" AS step, round(avg(x), 6) AS mean, count(*) AS votes FROM chunks GROUP BY ALL')
def ensemble_mean(spark, sf_dir):
    return rounded(ensemble.ensemble_mean(_chunks(spark, sf_dir), ["user_id"], "frame_index", "chunk"), "mean")


@query(f'WITH {CHUNKS} SELECT user_id, frame_index + "offset" AS step, round(x, 6) AS x FROM chunks WHERE frame_index % 2 = 0 AND "offset" < 2')
def replan_queue(spark, sf_dir):
    return rounded(ensemble.replan_queue(_chunks(spark, sf_dir), ["user_id"], "frame_index", "chunk", 2), "x")


@query(
    f"""WITH {CHUNKS} SELECT user_id, frame_index + "offset" AS step, round(avg(x), 6) AS mean, count(*) AS votes FROM chunks
WHERE frame_index % 2 = 0 AND frame_index <= (frame_index + "offset") // 2 * 2 GROUP BY ALL"""
)
def replan_ensemble(spark, sf_dir):
    return rounded(ensemble.replan_ensemble(_chunks(spark, sf_dir), ["user_id"], "frame_index", "chunk", 2), "mean")


@query(
    f"""WITH {CHUNKS} SELECT user_id, frame_index,
  round(sum(CASE WHEN pad THEN 0 ELSE x * x END) / greatest(count(*) FILTER (NOT pad), 1), 6) AS loss FROM chunks GROUP BY ALL"""
)
def masked_mean(spark, sf_dir):
    from framewright.operators.stats import masked_mean as mean

    rows = temporal.delta_rows(frames(spark, sf_dir), "value", [0, 1, 2, 3], "user_id")
    out = rows.groupBy("user_id", "frame_index").agg(mean(F.col("value") * F.col("value"), F.col("is_pad")).alias("loss"))
    return rounded(out, "loss")


@query(
    f"""WITH {FRAMES} SELECT user_id, round(sum(CASE WHEN channel >= 50 THEN value * (1 + frame_index % 3) ELSE 0 END)
  / greatest(count(*) FILTER (channel >= 50), 1), 6) AS loss FROM frames GROUP BY user_id"""
)
def weighted_mean(spark, sf_dir):
    from framewright.operators.stats import weighted_mean as mean

    weight, keep = 1 + F.col("frame_index") % 3, F.coalesce(F.col("channel") >= 50, F.lit(False))
    out = frames(spark, sf_dir).groupBy("user_id").agg(mean(F.col("value"), weight, keep).alias("loss"))
    return rounded(out, "loss")


@query(
    f"""WITH {CHUNKS} SELECT user_id, frame_index, "offset", round(CASE WHEN pad THEN 0 ELSE x END, 6) AS x FROM chunks"""
)
def zero_padded_deltas(spark, sf_dir):
    got = temporal.delta_window(frames(spark, sf_dir), "value", [0, 1, 2, 3], "user_id")
    rows = got.select("user_id", "frame_index", F.posexplode(vectors.zero_padded(F.col("window"), F.col("is_pad"))).alias("offset", "x"))
    return rounded(rows, "x")


@query(
    f"""WITH {CHUNKS} SELECT c.user_id, c.frame_index, c."offset", round(c.x - f.channel, 6) AS x
FROM chunks c JOIN frames f USING (user_id, frame_index)"""
)
def relative_to_first(spark, sf_dir):
    rows = _chunks(spark, sf_dir).withColumn("state", F.array("channel"))
    shifted = rows.select("user_id", "frame_index", F.posexplode(vectors.relative_to(F.col("chunk"), F.col("state"))).alias("offset", "x"))
    return rounded(shifted, "x")


@query(
    f"""WITH {FRAMES} SELECT q.user_id, q.frame_index, count(*) FILTER (WHERE q.frame_index >= k.frame_index) AS seen, count(*) AS keys,
  round(sum(CASE WHEN q.frame_index >= k.frame_index THEN k.value END), 4) AS total FROM frames q JOIN frames k ON k.user_id = q.user_id GROUP BY ALL"""
)
def causal_mask(spark, sf_dir):
    """The frames that each frame of an episode may see, and their sum."""
    rows = frames(spark, sf_dir)
    both = rows.select("user_id", "frame_index").join(rows.select("user_id", F.col("frame_index").alias("k"), "value"), "user_id")
    sees = temporal.causal_mask(both, "frame_index", "k")
    told = both.groupBy("user_id", "frame_index").agg(F.count_if(sees).alias("seen"), F.count("*").alias("keys"), F.sum(F.when(sees, F.col("value"))).alias("total"))
    return rounded(told, "total", places=4)


@query(
    """WITH n AS (SELECT count(*) AS n, CAST(greatest(100, least(10000, floor(pow(count(*), 0.75)))) AS BIGINT) AS w FROM documents),
p AS (SELECT CAST(round_even(k * (n.n - 1) / CAST(least(w, n.n) - 1 AS DOUBLE), 0) AS BIGINT) AS place FROM n, range(10001) r(k) WHERE k < least(w, n.n))
SELECT d.doc_id, d.lang FROM documents d JOIN p ON d.doc_id = p.place"""
)
def even_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    places = docs.agg(F.count("*").alias("n")).select(F.explode(episodes.even_places(F.col("n"))).alias("doc_id"))
    return docs.join(F.broadcast(places), "doc_id").select("doc_id", "lang")  # at most 10,000 places


@query(
    """WITH o AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, CASE WHEN place < floor(n * 0.9) THEN 'train' ELSE 'held' END AS part, count(*) AS frames FROM events JOIN o USING (user_id) GROUP BY ALL"""
)
def split_episodes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id")
    return events.join(episodes.split_table(events, "user_id", 0.1), "user_id").groupBy("user_id", "part").agg(F.count("*").alias("frames"))


@query(
    """WITH s AS (SELECT user_id % 3 AS dataset, count(*) AS length FROM events GROUP BY ALL),
o AS (SELECT dataset, length, coalesce(sum(length) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT e.event_id, o.dataset, CAST(e.event_id - o.b AS BIGINT) AS local_row FROM events e JOIN o ON e.event_id >= o.b AND e.event_id < o.b + o.length"""
)
def dataset_route(spark, sf_dir):
    """A place over all datasets as a dataset and a row of it."""
    events = table(spark, sf_dir, "events")
    sizes = events.groupBy((F.col("user_id") % 3).alias("dataset")).agg(F.count("*").alias("length"))
    return episodes.route(events.select("event_id"), "event_id", sizes, "dataset")


@query("SELECT event_id, event_id // 64 AS batch, event_id % 64 AS in_batch FROM events WHERE event_id % 4 = 1")
def rank_batches(spark, sf_dir):
    rows = episodes.shard(table(spark, sf_dir, "events").select("event_id"), "event_id", 1, 4)
    return episodes.batches(rows, "event_id", 64)


@query(
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5('9:' || event_id), event_id) - 1 AS place FROM events)
SELECT event_id, place FROM o WHERE place >= 128"""
)
def epoch_order(spark, sf_dir):
    return episodes.epoch_order(table(spark, sf_dir, "events").select("event_id"), "event_id", seed=7, epoch=2, skip=128)


@query(
    f"""WITH {CHUNKS}, m AS (SELECT user_id, frame_index + "offset" AS step, round(avg(x), 6) AS mean, count(*) AS votes FROM chunks GROUP BY ALL)
SELECT * FROM m"""
)
def ensemble_stream(spark, sf_dir):
    """The same means from a stream of chunks: steps are out once a later chunk, or the rollout's end, has settled them."""
    given, out, state = (new_path(spark, f"ensemble-{part}") for part in ("in", "out", "state"))
    chunks = _chunks(spark, sf_dir).select(F.col("user_id").alias("rollout"), F.col("frame_index").alias("start"), "chunk")
    ends = chunks.groupBy("rollout").agg((F.max("start") + 1).alias("start")).withColumn("chunk", F.lit(None).cast("array<double>"))
    chunks.unionByName(ends).write.parquet(given)
    source = spark.readStream.schema("rollout long, start long, chunk array<double>").parquet(given)
    stream = ensembler.ensemble_stream(source).writeStream.format("parquet").outputMode("append")
    stream.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    settled = spark.read.schema(ensembler.OUTPUT).parquet(out)
    return rounded(settled.select(F.col("rollout").alias("user_id"), "step", "mean", "votes"), "mean")


@query(
    f"""WITH {FRAMES} SELECT q.user_id, q.frame_index, count(*) FILTER (WHERE k.frame_index < 4 OR q.frame_index // 4 >= k.frame_index // 4) AS group_sees,
  count(*) FILTER (WHERE q.frame_index // 4 = k.frame_index // 4) AS same_group FROM frames q JOIN frames k ON k.user_id = q.user_id GROUP BY ALL"""
)
def group_causal_mask(spark, sf_dir):
    """Groups of four frames: those that each frame sees, and those of its own group."""
    rows = frames(spark, sf_dir).select("user_id", "frame_index")
    both = rows.join(rows.withColumnRenamed("frame_index", "k"), "user_id")
    q, k = F.col("frame_index"), F.col("k")
    return both.groupBy("user_id", "frame_index").agg(
        F.count_if(temporal.group_causal(q, k, 4)).alias("group_sees"), F.count_if(temporal.same_group(q, k, 4)).alias("same_group")
    )
