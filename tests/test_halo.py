from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewright.functions import text as fx
from framewright.operators import episodes, halo, lookups, temporal
from framewright.sources import datasets


def frames(spark, lengths):
    rows = [(e, i, float(e * 1000 + i * i), "own") for e, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "e long, frame_index long, x double, range string")


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
@pytest.mark.parametrize("deltas", [[0, 1, 2], [-4, 0, 3], [-9], [50]])
def test_ranges_change_nothing(spark, span, deltas):
    rows = frames(spark, [1, 2, 20, 7])
    want = sorted(map(tuple, temporal.delta_window(rows, "x", deltas, "e").collect()), key=str)
    got = halo.delta_window(rows, "x", deltas, "e", span=span)
    assert got.columns == [*rows.columns, "window", "is_pad"] and sorted(map(tuple, got.collect()), key=str) == want


def test_sliding_and_steps_in_ranges(spark):
    rows = frames(spark, [1, 12, 5])
    want = sorted(map(tuple, temporal.sliding_window(rows, "x", 5, "e").collect()), key=str)
    assert sorted(map(tuple, halo.sliding_window(rows, "x", 5, "e", span=4).collect()), key=str) == want
    want = sorted(map(tuple, temporal.irregular_steps(rows, "x", 5.0, 3.0, "e").collect()), key=str)
    assert sorted(map(tuple, halo.irregular_steps(rows, "x", 5.0, 3.0, "e", span=4).collect()), key=str) == want
    with pytest.raises(ValueError, match="negative"):
        halo.in_ranges(rows, "e", "frame_index", -1, 0, lambda r, k: r)


def test_one_long_episode_is_dealt_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("e"), F.col("id").alias("frame_index"), F.col("id").cast("double").alias("x"))
    got = halo.delta_window(rows, "x", [-1, 0, 1], "e", span=1000)
    assert got.count() == 20_000
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in parts) < 20_000


def test_numbers_in_blocks_as_over_whole_episodes(spark):
    rows = spark.createDataFrame([(k % 3, float(k * 37 % 101) if k % 11 else 5.0, k, 1) for k in range(200)] + [(None, 1.0, 900, 1)], "e long, t double, k long, block int")
    want = sorted(map(tuple, episodes.number_frames(rows, "e", "t", "k").collect()), key=str)
    got = episodes.number_frames_in_blocks(rows, "e", "t", 10.0, "k")
    assert got.columns == [*rows.columns, "frame_index"] and sorted(map(tuple, got.collect()), key=str) == want


def test_many_datasets_are_routed_as_few(spark):
    sizes = spark.createDataFrame([(d, (d * 7) % 5) for d in range(40)], "dataset long, length long")
    places = spark.range(120).withColumnRenamed("id", "place")
    few = sorted(map(tuple, episodes.route(places, "place", sizes, "dataset").collect()))
    many = episodes.route(places, "place", sizes, "dataset", few=3)
    assert sorted(map(tuple, many.select("place", "dataset", "local_row").collect())) == few and len(few) == sum((d * 7) % 5 for d in range(40))


def test_texts_in_roles_share_one_numbering(spark):
    known = spark.createDataFrame([("a", 4)], "task string, task_index long")
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id long, task string, quality string")
    told, table = lookups.role_indices(rows, known, {"task": "i", "quality": "j"}, "task", "task_index")
    assert sorted(tuple(r) for r in told.select("id", "i", "j").collect()) == [(1, 4, 5), (2, 6, None)]
    assert sorted(tuple(r) for r in table.collect()) == [("a", 4), ("b", 5), ("c", 6)]


def test_files_are_put_into_rows(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "e.bin").write_bytes(b"e")
    listed = {r.name: r.length for r in datasets.list_files(spark, str(tmp_path)).collect()}
    assert sorted(listed.values()) == [1, 2] and {n.split("/")[-1][-5:] for n in listed} == {"b.bin", "e.bin"}
    rows = spark.createDataFrame([(1, n) for n in listed] + [(2, n) for n in listed] + [(3, None)], "id long, name string")
    got = {(r.id, r.name): None if r.file is None else bytes(r.file.bytes) for r in datasets.embed_files(rows, "name", str(tmp_path), "file").collect()}
    assert got == {(i, n): b"\x00\xff" if listed[n] == 2 else b"e" for i in (1, 2) for n in listed} | {(3, None): None}
    lost = spark.createDataFrame([(1, "nothing.bin")], "id long, name string")
    with pytest.raises(Exception, match="no such file"):
        datasets.embed_files(lost, "name", str(tmp_path), "file").collect()


def test_packed_frames_are_pruned_by_row_groups(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 100).alias("episode_index"), F.floor(F.col("id") / 100).alias("frame_index"))
    datasets.write_packed(rows, str(tmp_path), files=8)
    found = datasets.read_packed(spark, str(tmp_path), 10, 12)
    assert found.count() == 120 and datasets.read_packed(spark, str(tmp_path)).count() == 4000
    assert "GreaterThanOrEqual(episode_index,10)" in found._jdf.queryExecution().executedPlan().toString()
    ranges = [r for r in spark.read.parquet(f"{tmp_path}/packed").groupBy(F.input_file_name()).agg(F.min("episode_index").alias("a"), F.max("episode_index").alias("b")).collect()]
    assert len(ranges) == 8 and all(r.b - r.a < 20 for r in ranges)


def test_share_of_instructions_without_their_first_part(spark):
    rows = spark.range(4000).select(fx.instruction(F.lit("h"), F.lit("l"), 0.25, F.col("id")).alias("t"))
    assert abs(rows.filter("t = 'l'").count() / 4000 - 0.25) < 0.03
