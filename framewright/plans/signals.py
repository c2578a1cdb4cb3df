"""Queries over statistics, normalisation, vectors and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import normalize, schedules
from framewright.operators import stats, temporal, vectors
from framewright.plans.registry import FRAMES, frames, query, rounded, table

_FIVE = ("min", "max", "mean", "std")
_VECTORS = "v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
_STEPS = f"""{FRAMES}, w AS (
  SELECT a.user_id, j.j AS step, b.value AS x FROM frames a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS j) j
  JOIN frames b ON b.user_id = a.user_id AND b.frame_index = least(a.frame_index + j.j, a.n - 1)),
s AS (SELECT user_id, step, min(x) AS mn, max(x) AS mx, avg(x) AS mu, var_samp(x) AS v, quantile_cont(x, 0.01) AS q01,
  quantile_cont(x, 0.99) AS q99 FROM w GROUP BY ALL)"""


def _vectors(spark, sf_dir):
    return stats.long_form(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "embedding")


def _step_stats(spark, sf_dir):
    got = temporal.sliding_window(frames(spark, sf_dir), "value", 4, "user_id")
    rows = got.select("user_id", F.posexplode("chunk").alias("step", "x"))
    return stats.episode_stats(rows, ["user_id", "step"])


@query(
    f"""WITH {_VECTORS} SELECT label, dim, round(min(CAST(x AS DOUBLE)), 6) AS min, round(max(CAST(x AS DOUBLE)), 6) AS max, round(avg(CAST(x AS DOUBLE)), 6) AS mean,
  round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std, count(*) AS count FROM v GROUP BY label, dim"""
)
def episode_feature_stats(spark, sf_dir):
    return rounded(stats.feature_stats(_vectors(spark, sf_dir), ["label", "dim"]), *_FIVE)


@query("SELECT round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS count FROM events")
def stats_partial_final(spark, sf_dir):
    parts = stats.feature_stats(table(spark, sf_dir, "events"), ["user_id"], "value")
    return rounded(stats.merge_stats(parts, []), *_FIVE)


@query(
    f"""WITH {_STEPS} SELECT user_id, step, round(mn, 6) AS min, round(mx, 6) AS max, round(mu, 9) AS mu, round(v, 6) AS var,
  round(q01, 6) AS q01, round(q99, 6) AS q99 FROM s"""
)
def stats_stepwise(spark, sf_dir):
    return rounded(rounded(_step_stats(spark, sf_dir), "min", "max", "var", "q01", "q99"), "mu", places=9)


_MERGE = """round(min(mn), 6) AS min, round(max(mx), 6) AS max, round(avg(mu), 6) AS mean,
  round(sqrt(avg(v + pow(mu - m, 2))), 6) AS std, round(min(q01), 6) AS q01, round(max(q99), 6) AS q99"""


@query(f"WITH {_STEPS}, t AS (SELECT *, avg(mu) OVER (PARTITION BY step) AS m FROM s) SELECT step, {_MERGE} FROM t GROUP BY step")
def stats_unweighted_merge(spark, sf_dir):
    merged = stats.merge_episodes(_step_stats(spark, sf_dir), ["step"])
    return rounded(merged, *_FIVE, "q01", "q99")


@query(f"WITH {_STEPS}, t AS (SELECT *, avg(mu) OVER () AS m FROM s) SELECT {_MERGE} FROM t")
def stats_envelope(spark, sf_dir):
    merged = stats.merge_episodes(_step_stats(spark, sf_dir), [])
    return rounded(merged, *_FIVE, "q01", "q99")


@query(f"WITH {_VECTORS} SELECT dim, round(greatest(stddev_samp(CAST(x AS DOUBLE)), 1e-3), 6) AS std FROM v GROUP BY dim")
def channel_std_floor(spark, sf_dir):
    return rounded(_vectors(spark, sf_dir).groupBy("dim").agg(stats.floored_std(F.col("x")).alias("std")), "std")


@query(f"WITH {_VECTORS} SELECT vec_id, round(sqrt(avg(CAST(x AS DOUBLE) * x)), 6) AS rms FROM v GROUP BY vec_id")
def vector_rms(spark, sf_dir):
    return rounded(_vectors(spark, sf_dir).groupBy("vec_id").agg(stats.root_mean_square(F.col("x")).alias("rms")), "rms")


def _normalized(spark, sf_dir, mode, **measures):
    """Frames with y, the value normalised by its user's measures, and x, restored from it."""
    f = frames(spark, sf_dir).select("user_id", "frame_index", "value")
    m = f.groupBy("user_id").agg(*[e.alias(k) for k, e in measures.items()]) if measures else None
    met = f.join(m, "user_id") if m is not None else f
    scale, offset = normalize.coefficients(mode, {k: F.col(k) for k in measures})
    return met.withColumns({"y": normalize.normalize(F.col("value"), scale, offset), "scale": scale, "offset": offset})


_NORM = """WITH {frames}, m AS (SELECT user_id, {measures} FROM frames GROUP BY user_id),
y AS (SELECT f.user_id, f.frame_index, f.value, {scale} AS s, {offset} AS o FROM frames f JOIN m USING (user_id))
SELECT user_id, frame_index, round(greatest(-5, least(5, value * s + o)), 6) AS y FROM y"""
_RANGE = {
    "scale": "CASE WHEN hi - lo < 1e-4 THEN 1 ELSE 2 / (hi - lo) END",
    "offset": "CASE WHEN hi - lo < 1e-4 THEN -lo ELSE -1 - lo * 2 / (hi - lo) END",
}


@query(_NORM.format(frames=FRAMES, measures="min(value) AS lo, max(value) AS hi", **_RANGE))
def normalize_minmax(spark, sf_dir):
    out = _normalized(spark, sf_dir, "min/max", min=F.min("value"), max=F.max("value"))
    return rounded(out.select("user_id", "frame_index", "y"), "y")


@query(
    _NORM.format(frames=FRAMES, measures="avg(value) AS mu, stddev_pop(value) AS sd", scale="1 / (sd + 1e-8)", offset="-mu / (sd + 1e-8)")
)
def normalize_zscore(spark, sf_dir):
    out = _normalized(spark, sf_dir, "z-score", mean=F.avg("value"), std=F.stddev_pop("value"))
    return rounded(out.select("user_id", "frame_index", "y"), "y")


@query(_NORM.format(frames=FRAMES, measures="quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi", **_RANGE))
def normalize_quantile(spark, sf_dir):
    q = {f"q{k:02d}": F.percentile("value", F.lit(k / 100)) for k in (1, 99)}
    return rounded(_normalized(spark, sf_dir, "q01/q99", **q).select("user_id", "frame_index", "y"), "y")


@query(f"WITH {FRAMES} SELECT user_id, frame_index, round(greatest(-5, least(5, value * 0.02 - 1)), 6) AS y FROM frames")
def normalize_const(spark, sf_dir):
    return rounded(_normalized(spark, sf_dir, "0/100").select("user_id", "frame_index", "y"), "y")


@query(f"WITH {FRAMES} SELECT user_id, frame_index, round(value, 6) AS x FROM frames")
def denormalize_roundtrip(spark, sf_dir):
    out = _normalized(spark, sf_dir, "min/max", min=F.min("value"), max=F.max("value"))
    back = normalize.denormalize(F.col("y"), F.col("scale"), F.col("offset"))
    return rounded(out.select("user_id", "frame_index", back.alias("x")), "x")


@query(
    """WITH v AS (SELECT vec_id, list_concat(list_slice(embedding, 1, 6), list_slice(embedding, 9, 9), list_slice(embedding, 17, 22)) AS p FROM embeddings),
j AS (SELECT vec_id, p, unnest(range(16)) AS dim FROM v)
SELECT vec_id, dim, round(CAST(coalesce(p[dim + 1], 0) AS DOUBLE), 6) AS x, dim >= len(p) AS is_pad FROM j"""
)
def concat_pad(spark, sf_dir):
    e = F.col("embedding")
    parts = [vectors.as_vector(F.slice(e, 1, 6), 6), vectors.as_vector(F.element_at(e, 9), 1, scalar=True), vectors.as_vector(F.slice(e, 17, 6), 6)]
    joined = table(spark, sf_dir, "embeddings").select("vec_id", vectors.concat_parts(parts).alias("p"))
    zipped = F.arrays_zip(vectors.pad_right(F.col("p"), 16).alias("x"), vectors.pad_mask(F.size("p"), 16).alias("m"))
    out = joined.select("vec_id", F.posexplode(zipped).alias("dim", "z")).select("vec_id", "dim", F.col("z.x").alias("x"), F.col("z.m").alias("is_pad"))
    return rounded(out, "x")


@query(
    """WITH p AS (SELECT vec_id, unnest([{'part': 'arm', 'v': list_slice(embedding, 1, 6)}, {'part': 'gripper', 'v': list_slice(embedding, 7, 7)},
  {'part': 'torso', 'v': list_slice(embedding, 8, 11)}]) AS s FROM embeddings),
d AS (SELECT vec_id, s.part AS part, unnest(s.v) AS x, generate_subscripts(s.v, 1) - 1 AS dim FROM p)
SELECT vec_id, part, dim, round(CAST(x AS DOUBLE), 6) AS x FROM d"""
)
def split_parts(spark, sf_dir):
    parts = vectors.split_parts(F.col("embedding"), {"arm": 6, "gripper": 1, "torso": 4})
    each = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("v")) for n, v in parts.items()])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(each).alias("s"))
    return rounded(rows.select("vec_id", "s.part", F.posexplode("s.v").alias("dim", "x")), "x")


@query(
    """WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v"""
)
def frame_assembly(spark, sf_dir):
    v = vectors.assemble(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(v).alias("dim", "x"))


@query(
    """WITH q AS (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, greatest(-1, least(1, CAST(embedding[4] AS DOUBLE))) AS w FROM embeddings),
t AS (SELECT *, sqrt(greatest(0, 1 - w * w)) AS s FROM q), u AS (SELECT *, CASE WHEN s > 0 THEN 2 * acos(w) / s ELSE 0 END AS f FROM t)
SELECT vec_id, round(a * f, 6) AS rx, round(b * f, 6) AS ry, round(c * f, 6) AS rz, CASE WHEN a >= 0.5 THEN 1.0 ELSE -1.0 END AS grip FROM u"""
)
def sim_state(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    r = rows.select("vec_id", vectors.axis_angle(F.col("embedding").cast("array<double>")).alias("r"), vectors.gripper(F.element_at("embedding", 1)).alias("grip"))
    out = r.select("vec_id", F.element_at("r", 1).alias("rx"), F.element_at("r", 2).alias("ry"), F.element_at("r", 3).alias("rz"), F.col("grip").cast("double").alias("grip"))
    return rounded(out, "rx", "ry", "rz")


@query(
    """WITH g AS (SELECT o_orderkey, o_orderkey % 1000 + 1 AS k, (o_orderkey % 1000 + 1) / 1000.0 AS u FROM orders), t AS (SELECT *, 3 * u / (1 + 2 * u) AS s FROM g),
y AS (SELECT *, exp(-2 * pow((s * 1000 - 500) / 1000, 2)) AS y FROM t), m AS (SELECT min(y) AS lo, avg(y) - min(y) AS mean FROM y)
SELECT o_orderkey, k, round(s, 6) AS sigma, round((y - lo) / (mean + 1e-10), 6) AS weight,
  round(CASE WHEN k < 300 THEN 1.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (k - 300) / 700.0))) END, 6) AS anneal,
  round(least(1, greatest(0, (k - 200) / 800.0)), 6) AS ramp,
  round(CASE WHEN k < 50 THEN 1e-4 * (1 / 50.0 + (1 - 1 / 50.0) * k / 50.0) ELSE 1e-6 + 0.99e-4 * 0.5 * (1 + cos(pi() * (k - 50) / 950.0)) END, 12) AS lr,
  CAST(ceil(k / 16.0) * 16 AS BIGINT) AS padded, CASE WHEN k % 4 = 1 THEN k ELSE (k + 3) // 4 * 4 + 1 END AS frames,
  (k - 1) // 4 + 1 AS groups, CAST(ceil(ceil(k / 32.0) / 2) AS BIGINT) AS steps
FROM y, m"""
)
def schedule_scalars(spark, sf_dir):
    """The scalars of a thousand training steps, an order at each; the weight is normalised over all rows."""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 + 1).alias("k"))
    grid = rows.withColumn("s", schedules.flow_shift(k / 1000.0, 3.0))
    grid = grid.withColumn("y", schedules.bell(F.col("s") * 1000.0, 1000.0))
    m = grid.agg(F.min("y").alias("lo"), (F.avg("y") - F.min("y")).alias("mean"))
    out = grid.crossJoin(F.broadcast(m)).select(  # one row
        "o_orderkey",
        "k",
        F.round("s", 6).alias("sigma"),
        F.round((F.col("y") - F.col("lo")) / (F.col("mean") + 1e-10), 6).alias("weight"),
        F.round(schedules.cosine_knee(k, 300, 1000, 1.0, 0.1), 6).alias("anneal"),
        F.round(schedules.linear_ramp(k, 200.0, 1000), 6).alias("ramp"),
        F.round(schedules.learning_rate(k, 1000, 1e-4, 50), 12).alias("lr"),
        schedules.ceil_to(k).cast("long").alias("padded"),
        schedules.frames_to_groups(k).alias("frames"),
        schedules.window_frames(k, 4).alias("groups"),
        schedules.steps_per_epoch(k, 16, 2, 2).cast("long").alias("steps"),
    )
    return out


@query(
    f"""WITH {FRAMES} SELECT user_id, frame_index, round((1 - 0.25) * value + 0.25 * channel, 6) AS noisy, round(channel - value, 6) AS target,
  round(value + (channel - value) * -0.25, 6) AS stepped FROM frames"""
)
def noise_steps(spark, sf_dir):
    x, n = F.col("value"), F.col("channel")
    v = schedules.velocity(x, n)
    out = frames(spark, sf_dir).select(
        "user_id",
        "frame_index",
        schedules.interpolate(x, n, F.lit(0.25)).alias("noisy"),
        v.alias("target"),
        schedules.euler_step(x, v, F.lit(0.5), F.lit(0.25)).alias("stepped"),
    )
    return rounded(out, "noisy", "target", "stepped")
