from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import normalize, schedules
from framewright.functions import text as fx
from framewright.operators import ensemble, episodes, lookups, sets, stats, summary, temporal, vectors


def frame(spark, lengths):
    rows = [(e, i, float(10 * e + i)) for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "ep long, frame_index long, x double")


def test_ensemble_of_overlapping_chunks(spark):
    chunks = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [4.0])], "r long, start long, c array<double>")
    got = {r.step: (r.mean, r.votes) for r in ensemble.ensemble_mean(chunks, ["r"], "start", "c").collect()}
    assert got == {0: (1.0, 1), 1: (3.0, 2)}


@pytest.mark.parametrize(("n", "want"), [(1000, 177), (2000, 299), (5000, 594), (10000, 1000), (20000, 1681), (50, 50)])
def test_sample_sizes(spark, n, want):
    places = spark.range(1).select(episodes.even_places(F.lit(n).cast("long")).alias("p")).first().p
    assert len(places) == want
    assert places == np.round(np.linspace(0, n - 1, want)).astype(int).tolist()


def test_windows_hold_the_ends_and_mark_them(spark):
    got = {(r.ep, r.frame_index): (r.window, r.is_pad) for r in temporal.delta_window(frame(spark, [3, 1]), "x", [-1, 0, 2], "ep").collect()}
    assert got[0, 0] == ([0.0, 0.0, 2.0], [True, False, False])
    assert got[0, 2] == ([1.0, 2.0, 2.0], [False, False, True])
    assert got[1, 0] == ([10.0, 10.0, 10.0], [True, False, True])


def test_null_values_inside_an_episode_stay_null(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0)], "ep long, frame_index long, x double")
    got = {r.frame_index: r.window for r in temporal.delta_window(rows, "x", [1], "ep").collect()}
    assert got == {0: [None], 1: [3.0], 2: [3.0]}


def test_sliding_window_repeats_the_last(spark):
    got = [r.chunk for r in temporal.sliding_window(frame(spark, [3]), "x", 2, "ep").orderBy("frame_index").collect()]
    assert got == [[0.0, 1.0], [1.0, 2.0], [2.0, 2.0]]


def test_nearest_is_strict_and_takes_the_earlier(spark):
    frames = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 5.0)], "u long, t double")
    queries = spark.createDataFrame([(0, 1.5), (0, 3.0), (0, 7.0), (1, 1.0)], "u long, t double")
    got = {(r.u, r.t): r.found_time for r in temporal.nearest(queries, frames, "u", "t", 1.0).collect()}
    assert got == {(0, 1.5): 1.0, (0, 3.0): None, (0, 7.0): None, (1, 1.0): None}
    with pytest.raises(Exception, match="no frame within"):
        temporal.require_matches(temporal.nearest(queries, frames, "u", "t", 1.0)).collect()


def test_offsets_in_seconds():
    assert temporal.delta_indices([0.0, 0.1, -0.2], 10) == [0, 1, -2]
    with pytest.raises(ValueError, match="multiples"):
        temporal.delta_indices([0.05], 10)


def test_pooled_statistics_merge_exactly(spark):
    rows = frame(spark, [5, 1, 9])
    direct = stats.feature_stats(rows, [], "x").first()
    merged = stats.merge_stats(stats.feature_stats(rows, ["ep"], "x"), []).first()
    assert all(math.isclose(direct[c], merged[c]) for c in ("min", "max", "mean", "std", "count"))


def test_normaliser_statistics_weigh_episodes_alike(spark):
    rows = frame(spark, [4, 2, 1])  # the last has no sample variance and is passed over in the spread
    merged = stats.merge_episodes(stats.episode_stats(rows, ["ep"]), []).first()
    values = [[0.0, 1, 2, 3], [10.0, 11], [20.0]]
    mean = np.mean([np.mean(v) for v in values])
    spread = math.sqrt(np.mean([np.var(v, ddof=1) + (np.mean(v) - mean) ** 2 for v in values[:2]]))
    assert math.isclose(merged["mean"], mean) and math.isclose(merged["std"], spread)
    assert math.isclose(merged["q01"], min(np.quantile(v, 0.01) for v in values))


def test_normalisation_and_its_inverse(spark):
    one = spark.createDataFrame([(3.0,), (float("nan"),), (1e9,)], "x double")
    scale, offset = normalize.between(F.lit(1.0), F.lit(5.0))
    y = normalize.normalize(F.col("x"), scale, offset)
    got = [r[0] for r in one.select(y).collect()]
    assert got[0] == 0.0 and math.isnan(got[1]) and got[2] == 5.0
    assert one.limit(1).select(normalize.denormalize(y, scale, offset)).first()[0] == 3.0
    flat = normalize.between(F.lit(2.0), F.lit(2.0))
    assert one.limit(1).select(normalize.normalize(F.col("x"), *flat)).first()[0] == 1.0
    assert normalize.mode_of("arm", "z-score", {"arm": "-1/1"}) == "-1/1"


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, False], [0.0, 0.0, 1.0, 0.0])], "v array<double>, p array<boolean>, q array<double>")
    v = F.col("v")
    got = row.select(
        vectors.pad_right(v, 5).alias("pad"),
        vectors.pad_mask(F.size(v), 5).alias("mask"),
        vectors.zero_padded(v, F.col("p")).alias("zero"),
        vectors.drop_last(v).alias("short"),
        vectors.fit_cameras(v, 4, F.lit(0.0)).alias("more"),
        vectors.fit_cameras(v, 2, F.lit(0.0)).alias("fewer"),
        vectors.axis_angle(F.col("q")).alias("turn"),
        vectors.absolute_from(vectors.relative_to(v, v), v).alias("same"),
    ).first()
    assert got["pad"] == [1.0, 2.0, 3.0, 0.0, 0.0] and got["mask"] == [False] * 3 + [True] * 2
    assert got["zero"] == [0.0, 2.0, 3.0] and got["short"] == [1.0, 2.0]
    assert got["more"] == [1.0, 2.0, 3.0, 0.0] and got["fewer"] == [1.0, 2.0]
    assert np.allclose(got["turn"], [0, 0, math.pi]) and got["same"] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="not 4 wide"):
        row.select(vectors.as_vector(v, 4)).collect()


def test_lookups(spark):
    tasks = spark.createDataFrame([(0, "a", 0), (1, "b", 1), (1, "c", 2)], "task_index long, task string, line int")
    last = lookups.last_wins(tasks, "task_index", "line")
    rows = spark.createDataFrame([(1, 1), (2, 7)], "id long, task_index long")
    assert {r.id: r.task for r in lookups.lookup(rows, last, "task_index", "task").collect()} == {1: "c", 2: None}
    with pytest.raises(Exception, match="no task for task_index 7"):
        lookups.require_lookup(rows, last, "task_index", "task").collect()


def test_sets(spark):
    a, b = (spark.createDataFrame([(1, 2)], s) for s in ("x int, y int", "y int, z int"))
    assert sets.common_columns([a, b]) == ["y"]
    with pytest.raises(ValueError, match="in common"):
        sets.common_columns([a, spark.createDataFrame([(1,)], "q int")])


def test_splits():
    assert episodes.split([3, 1, 2], 0.0) == ([3, 1, 2], [])
    train, held = episodes.split(list(range(10)), 0.25)
    order = list(range(10))
    np.random.default_rng(42).shuffle(order)
    assert (train, held) == (order[:7], order[7:])


def test_counts_that_drift_fail(spark):
    with pytest.raises(Exception, match="expected 3 episodes, found 2"):
        episodes.require_count(frame(spark, [1, 1]), "ep", 3).collect()


def test_texts(spark):
    one = spark.createDataFrame([("  A_b 　 C!  ", "x@y@z", "&amp;lt;b&amp;gt; ")], "a string, t string, h string")
    got = one.select(
        fx.clean_whitespace(F.col("a")), fx.canonical_clean(F.col("a")), fx.side(F.col("t"), True), fx.basic_clean(F.col("h")),
        fx.slug(F.lit("Pick -- up, the CUP!")), fx.squeezed_name(F.lit("org/Model-1.2B")), fx.run_tag(F.lit("a/runs/x/y/step.pt")),
        fx.run_tag(F.lit("a/step_10.pt")), fx.percentage(F.lit(0.12345)), fx.shape_hash(F.array(F.lit("b:1"), F.lit("a:2"))),
    ).first()
    assert tuple(got)[:9] == ("A_b C!", "a b c", "y@z", "<b>", "pick_up_the_cup", "model12b", "x_y", "step_10", "12.35")
    with pytest.raises(Exception, match="not two sides"):
        one.select(fx.require_two_sides(F.col("t"), True)).collect()
    with pytest.raises(Exception, match="not a truth value"):
        one.select(fx.parse_bool(F.lit("maybe"))).collect()


def test_instructions(spark):
    rows = spark.createDataFrame([(k, "tidy", "pick") for k in range(400)] + [(401, "tidy", None)], "k long, h string, l string")
    made = lambda p: rows.select("k", fx.instruction(F.col("h"), F.col("l"), p, F.col("k")).alias("i")).collect()
    assert {r.i for r in made(0.0)} == {"[High]: tidy, [Low]: pick", "[high] tidy"}
    dropped = sum(r.i == "pick" for r in made(0.25))
    assert 60 < dropped < 140


def test_schedules(spark):
    k = F.col("id").cast("double")
    rows = spark.range(0, 8).select("id", schedules.frames_to_groups(F.col("id")).alias("g"), schedules.remaining_seconds(k, F.lit(8.0), k * 2).alias("left")).collect()
    assert [r.g for r in rows] == [1, 1, 5, 5, 5, 5, 9, 9]
    assert rows[0].left is None and rows[4].left == 8.0


def test_reports(spark):
    results = spark.createDataFrame([("spatial", 0, 4, 3, 2.0), ("spatial", 1, 4, 1, 3.0), ("odd", 0, 0, 0, 1.0)], "s string, t int, n long, k long, d double")
    rows = {r.s: r for r in summary.rollup(results, "s", "n", "k", "d").collect()}
    assert (rows["spatial"].trials, rows["spatial"].successes, rows["spatial"].success_rate) == (8, 4, 0.5)
    assert rows["odd"].success_rate == 0.0
    assert summary.overall(results, "n", "k", "d").first().trials == 8
    assert summary.known_suites(results, "s", ["spatial"]).count() == 2
    lines = spark.createDataFrame([("f", 0, "episode 1"), ("f", 1, "0.25"), ("f", 2, " 0.75 "), ("g", 0, "none")], "f string, at int, line string")
    assert {r.f: r.last_value for r in summary.last_number(lines, "f", "line", "at").collect()} == {"f": 0.75}


def test_stream_settles_steps_as_chunks_come(spark, tmp_path):
    from framewright.streaming.ensembler import ensemble_stream

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "rollout long, start long, chunk array<double>"
    given = [[(0, 0, [1.0, 2.0, 3.0])], [(0, 1, [4.0, 5.0, 6.0]), (1, 0, [9.0])], [(0, 3, [0.0])]]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    stream = ensemble_stream(source).writeStream.format("memory").queryName("settled").outputMode("append")
    job = stream.option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k, rows in enumerate(given):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("rollout", "start", "chunk"), r))) for r in rows))
            job.processAllAvailable()
    finally:
        job.stop()
    got = {(r.rollout, r.step): (r["mean"], r.votes) for r in spark.table("settled").collect()}
    assert got == {(0, 0): (1.0, 1), (0, 1): (3.0, 2), (0, 2): (4.0, 2)}


def test_settings_and_formats(spark):
    from framewright.operators import checks

    rows = spark.createDataFrame([(128, "yuv420p"), (128, "GRAY8")], "n int, f string")
    assert checks.single_value(rows, "n").first().n == 128
    assert [r[0] for r in rows.select(checks.channels(F.col("f"))).collect()] == [3, 1]
    with pytest.raises(Exception, match="2 values of f"):
        checks.single_value(rows, "f").collect()
    size = checks.canvas([F.lit(3), F.lit(4)], [F.lit(5), F.lit(6)], "horizontal")
    assert tuple(rows.limit(1).select(*size).first()) == (7, 6)
    assert rows.limit(1).select(checks.over_length(F.array(F.lit(True), F.lit(False)))).first()[0] is False
