from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import nested
from framewright.operators import intervals, redraw, resample, sketches, stats, tiles, within
from framewright.plans import ranges

DATA = "/root/testdata/sf0.001"

span = st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 40), st.sampled_from([0, 0, 1, 2, 7, 33]))


def shares(a, b, x, y):
    if a == b or x == y:  # a point
        return (x <= a < y or a == x) if a == b else a <= x < b
    return a < y and x < b


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=12), st.lists(span, max_size=12))
def test_overlaps_as_the_inequality(spark, left, right):
    lefts = [(k, by, a, a + n) for k, (by, a, n) in enumerate(left)]
    rights = [(k, by, a, a + n) for k, (by, a, n) in enumerate(right)]
    one = spark.createDataFrame(lefts, "i long, by string, a long, b long")
    two = spark.createDataFrame(rights, "j long, by string, u long, v long")
    got = intervals.overlaps(one, two, "by", ("a", "b"), ("u", "v"), hot=2)
    want = sorted((i, j) for i, p, a, b in lefts for j, q, u, v in rights if p == q and shares(a, b, u, v))
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want


def test_overlaps_have_no_nested_loop_and_few_rows(spark):
    """A span of ten million units is put into no more bins than one of ten."""
    one = spark.createDataFrame([(k, k * 10, k * 10 + (10 if k else 10_000_000)) for k in range(200)], "i long, a long, b long")
    two = spark.createDataFrame([(k, k * 50_000, k * 50_000 + 3) for k in range(200)] + [(None, 5, 6), (999, 9, 3)], "j long, u long, v long")
    met = intervals.overlaps(one, two, None, ("a", "b"), ("u", "v"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert met.filter("i = 0 AND j IS NOT NULL").count() == 200
    binned = intervals._binned(one, "a", "b", intervals.length_class(F.col("a"), F.col("b")), list(range(-2, 30)), 1.0)
    assert binned.groupBy("i", "cls").count().agg(F.max("count")).first()[0] <= 2


def test_small_groups_are_not_cut_into_bins(spark):
    """Segments of a user with few of them meet by user (F2); large groups beside them meet in bins, and no pair is lost."""
    assert "cls" not in ranges.segment_overlaps(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    rows = [(k, "few" if k % 10 == 0 else "many", 3 * k % 50, 3 * k % 50 + k % 6) for k in range(60)]
    one = spark.createDataFrame(rows, "i long, by string, a long, b long")
    two = one.selectExpr("i AS j", "by", "a AS u", "b AS v")
    got = intervals.overlaps(one, two, "by", ("a", "b"), ("u", "v"), hot=8)
    assert "cls" in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((i, j) for i, p, a, b in rows for j, q, u, v in rows if p == q and shares(a, b, u, v))
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want


def test_overlaps_name_what_clashes(spark):
    one = spark.createDataFrame([(1, 2, 3)], "i long, a long, b long")
    with pytest.raises(ValueError, match="differ"):
        intervals.overlaps(one, one, None, ("a", "b"), ("a", "b"))


def test_plan_of_the_query_has_no_nested_loop(spark):
    plan = ranges.interval_join(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_makes_no_row_for_each_pair(spark):
    """Points meet spans in chunks; no join of the two sides by kind or bin is left (F1)."""
    plan = ranges.interval_join(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "cls" not in plan and "moment_end" not in plan


@pytest.mark.parametrize("size", [3, 8192])
def test_totals_within_spans_by_hand(spark, size):
    """Spans in one chunk, over two, and over many; equal places, nulls, empty spans, repeated keys and values that swallow others."""
    points = [(g, (7 * k) % 40 // 2, None if k % 5 == 0 else 1e17 if k == 3 else k / 8, 1000 - k) for g in "xy" for k in range(60)]
    points += [("x", None, 1.0, 1), (None, 5, 1.0, 2), ("z", 4, None, 3)]
    spans = [(k % 50, "xyw"[k % 3], k % 23, k % 23 + k % 11) for k in range(120)] + [(500, "x", -9, 99), (501, "z", 4, 5), (502, None, 0, 9), (503, "y", None, 9)]
    one = spark.createDataFrame(spans, "k long, g string, a long, b long")
    two = spark.createDataFrame(points, "g string, at long, v double, i long").repartition(3)
    got = within.totals(one, two, "g", "k", ("a", "b"), "at", "v", "i", size=size).filter("n > 0")
    want = []
    for k, g, a, b in spans:
        there = [p for p in points if p[0] == g and g and p[1] is not None and a is not None and a <= p[1] < b]
        values = [p[2] for p in there if p[2] is not None]
        if there:
            want.append((k, len(there), sum(values) if values else None, min(p[3] for p in there)))
    told = sorted((tuple(r) for r in got.collect()), key=str)
    assert [(k, n, least) for k, n, _, least in told] == [(k, n, least) for k, n, _, least in sorted(want, key=str)]
    assert all(t == w or t == pytest.approx(w, rel=1e-12, abs=1e-9) for (*_, t, _), (*_, w, _) in zip(told, sorted(want, key=str)))


def test_redraw_is_repeatable_and_names_what_fails(spark):
    rows = [(k, None if k == 5 else k % 4 == 0, f"v{k}") for k in range(60)]
    samples = spark.createDataFrame(rows, "place long, ok boolean, served_by string")
    drawn = redraw.redraw(samples, tries=2, seed=3)
    one = {r.place: (r.drawn, r.tries_made, r.last) for r in drawn.collect()}
    two = {r.place: (r.drawn, r.tries_made, r.last) for r in redraw.redraw(samples.repartition(5), tries=2, seed=3).collect()}
    assert one == two and set(one) == set(range(60))
    for place, (d, tries, last) in one.items():
        assert (d == place and tries == 0) if place % 4 == 0 else d is None or d % 4 == 0 and tries in (1, 2) and last == d
    lost = {r.place for r in redraw.unserved(drawn).collect()}
    assert lost == {p for p, (d, _, _) in one.items() if d is None} and 0 < len(lost) < 45
    served = {r.place: r.served_by for r in redraw.serve(samples, drawn).collect()}
    assert served == {p: f"v{d}" for p, (d, _, _) in one.items() if d is not None}
    assert redraw.serve(samples, drawn, by="last").count() == 60
    with pytest.raises(Exception, match="no usable sample in 2 tries"):
        redraw.require_served(drawn).collect()
    none = {r.place: r.drawn for r in redraw.redraw(samples, tries=0).collect()}
    assert none == {k: k if k % 4 == 0 and k != 5 else None for k in range(60)}


def test_sketches_merge_and_stay_exact_where_small(spark):
    rows = spark.range(20_000).select((F.col("id") % 10).alias("g"), (F.col("id") % 200).alias("part"), (F.col("id") % 3_000).alias("item"), F.col("id").cast("double").alias("x"))
    parts = sketches.partial(rows, ["g", "part"], "x", "item")
    whole = sketches.merged(parts, ["g"], exact=100).select("g", "n", sketches.distinct_count().alias("d"), sketches.quantile(0.5).alias("m"), sketches.is_exact().alias("exact"))
    for r in whole.collect():
        assert r.n == 2000 and not r.exact
        assert abs(r.d - 300) <= 3 * sketches.distinct_error() * 300 + 1
        assert abs(r.m - 10_000) <= 2 * sketches.RANK_ERROR * 20_000
    small = sketches.merged(parts.filter("part < 10"), ["g"], exact=100).select("g", "n", sketches.distinct_count().alias("d"), sketches.quantile(0.5).alias("m"), sketches.is_exact().alias("exact"))
    for r in small.collect():
        assert (r.n, r.exact, r.m) == (100, True, r.g + 49 * 200) and r.d == 15


def test_sketches_of_large_groups_hold_no_values(spark):
    rows = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("x"), F.col("id").alias("i"))
    assert sketches.partial(rows, ["g"], "x", "i", exact=49).first()["values"] is None
    assert len(sketches.partial(rows, ["g"], "x", "i", exact=50).first()["values"]) == 50


def test_interpolation_at_and_beyond_the_ends(spark):
    samples = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 10.0, 30.0), ("a", 20.0, None), ("b", 5.0, 7.0)], "by string, t double, v double")
    asked = spark.createDataFrame([("a", x, "n") for x in (-1.0, 0.0, 2.5, 10.0, 15.0, None)] + [("b", 1.0, "n"), ("c", 1.0, "n"), ("b", 5.0, "n")], "by string, t double, k string")
    got = resample.interpolate(asked, samples, "by", "t", "v")
    assert got.columns == ["by", "t", "k", "interpolated"]
    told = {(r.by, r.t): r.interpolated for r in got.collect()}
    assert told == {("a", -1.0): 0.0, ("a", 0.0): 0.0, ("a", 2.5): 7.5, ("a", 10.0): 30.0, ("a", 15.0): 30.0, ("a", None): None, ("b", 1.0): 7.0, ("c", 1.0): None, ("b", 5.0): 7.0}


def test_resample_to_one_place_and_of_one_frame(spark):
    frames = spark.createDataFrame([(1, 0, 4.0), (2, 0, 1.0), (2, 1, 3.0)], "e long, f long, x double")
    assert sorted(tuple(r) for r in resample.resample(frames, "e", "f", "x", 3).collect()) == [(1, k, 0.0, 4.0) for k in range(3)] + [(2, 0, 0.0, 1.0), (2, 1, 0.5, 2.0), (2, 2, 1.0, 3.0)]
    assert [r.x for r in resample.resample(frames, "e", "f", "x", 1).orderBy("e").collect()] == [4.0, 1.0]


@pytest.mark.parametrize(("length", "size", "step"), [(1, 4, 2), (10, 4, 2), (11, 4, 3), (5, 8, 3), (12, 4, 4), (9, 6, 2)])
def test_tiles_by_hand(spark, length, size, step):
    rows = spark.range(length).select(F.col("id").alias("place"), F.lit(length).alias("n"))
    got = {(r.tile, r.place): r.weight for r in tiles.tiled(rows, "place", "n", size, step).collect()}
    want, border = {}, size - step
    for s in range(0, length, step):
        if s - step >= 0 and s - step + size >= length:
            continue
        inside = list(range(s, min(s + size, length)))
        ramp = [1.0] * len(inside)
        for k in range(min(border, len(inside)) if s else 0):
            ramp[k] = (k + 1) / border
        if s + size < length:
            for k in range(border):
                ramp[-1 - k] = (k + 1) / border
        want |= {(s, p): w for p, w in zip(inside, ramp)}
    assert got == want
    same = tiles.blended(tiles.tiled(rows.withColumn("x", F.col("place") * 1.5), "place", "n", size, step), ["place"], "x")
    assert all(abs(r.x - r.place * 1.5) < 1e-9 for r in same.collect()) and same.count() == length
    with pytest.raises(ValueError, match="gaps"):
        tiles.tiled(rows, "place", "n", 2, 3)


def test_nested_leaves(spark):
    df = spark.sql(
        "SELECT named_struct('a', 1.5D, 'b', array(named_struct('c', 2, 'd', 'x'), NULL), 'm', map('k', 4L)) AS v UNION ALL SELECT NULL"
    )
    kind = df.schema["v"].dataType
    leaf = nested.numbers_only(lambda x: x * 10)
    got = sorted(df.select(nested.map_leaves(F.col("v"), kind, leaf).alias("v")).collect(), key=str)
    assert [r.v for r in got if r.v] == [T.Row(a=15.0, b=[T.Row(c=20, d="x"), None], m={"k": 40})] and sum(r.v is None for r in got) == 1
    parts = nested.split_leaves(F.col("v"), kind, {"one": leaf, "two": lambda x, k: x})
    both = df.select(nested.reduce_leaves([parts["one"], parts["two"]], kind, lambda xs, k: F.greatest(*xs)).alias("v")).filter("v IS NOT NULL")
    assert both.first().v.a == 15.0 and both.first().v.b[0].c == 20 and both.first().v.m == {"k": 40}
    flat = spark.sql("SELECT named_struct('p', array(1, 2), 'q', named_struct('r', array(3), 's', 4)) AS v")
    assert flat.select(nested.concatenated(F.col("v"), flat.schema["v"].dataType)).first()[0] == [1, 2, 3, 4]


def test_even_sample_and_channels(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.array(F.array(F.array(F.col("id"), F.col("id") * 2)), F.array(F.array(F.lit(5), F.lit(5)))).alias("image"))
    chosen = stats.evenly_sampled(rows, ["g"], ["i"])
    places = sorted(r.i for r in chosen.collect())
    assert len(places) == 177 and places[0] == 0 and places[-1] == 999 and chosen.columns == rows.columns
    got = {r.channel: r for r in stats.channel_stats(chosen, ["g"], "image").collect()}
    assert got[0]["max"] == 1998.0 and got[1]["std"] == 0.0 and got[1]["mean"] == 5.0 and got[0]["count"] == 177
    assert stats.evenly_sampled(rows.limit(1), ["g"], ["i"]).count() == 1
