from __future__ import annotations

import json

import pytest
from pyspark.sql import types as T

from framewright.plans import metadata, tables
from framewright.sources import datasets, schema

FEATURES = {
    "action": {"dtype": "float32", "shape": (7,)},
    "observation.images.top": {"dtype": "video", "shape": (224, 224, 3)},
    "grid": {"dtype": "uint8", "shape": (2, 3)},
    "shot": {"dtype": "image", "shape": (2, 2, 3)},
}


def test_declared_features_make_a_schema():
    made = schema.table_schema(FEATURES)
    kinds = {f.name: f.dataType.simpleString() for f in made}
    assert kinds["action"] == "array<float>" and kinds["grid"] == "array<array<smallint>>"
    assert "observation.images.top" not in kinds and kinds["index"] == "bigint"
    assert schema.names_of(FEATURES, "video", "image") == ["observation.images.top", "shot"]
    with pytest.raises(ValueError, match="slash"):
        schema.table_schema({"a/b": FEATURES["action"]})
    with pytest.raises(ValueError, match="more than five"):
        schema.feature_type("float32", (1, 2, 3, 4, 5, 6))
    assert list(schema.joint_features(["j1", "j2"], {"top": (2, 2, 3)})) == ["observation.state", "observation.images.top"]


def test_faults(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    want = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("w", T.StringType())])
    assert schema.schema_faults(df, want) == ["missing w", "extra v", "id is bigint, not int"]
    assert [tuple(r) for r in schema.width_faults(df, {"v": 2}, "id").collect()] == [(1, "v", 1)]


def test_flatten_and_back(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 2)) AS a, 3 AS e")
    flat = schema.flatten(df)
    assert flat.columns == ["a/b", "a/c/d", "e"]
    assert schema.unflatten(flat).first().asDict(recursive=True) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}


def test_json_lines_with_control_characters(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "a\tb"}\n{"task_index": 1, "task": "x"}\n{"task_index": 1, "task": "y"}\n')
    assert {r.task_index: r.task for r in datasets.read_tasks(spark, str(tmp_path)).collect()} == {0: "a\tb", 1: "y"}


def test_results_are_read_and_checked(spark, tmp_path):
    folder = tmp_path / "spatial"
    folder.mkdir()
    whole = {"task_suite": "spatial", "task_id": 0, "successes": 3, "total_episodes": 4, "duration": 2.0}
    (folder / "gpu0_task0_results.json").write_text(json.dumps(whole, indent=1))
    (folder / "other.json").write_text("{}")
    assert [r.successes for r in datasets.read_results(spark, str(tmp_path)).collect()] == [3]
    (folder / "gpu0_task1_results.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "duration"}))
    with pytest.raises(Exception, match="a result lacks duration"):
        datasets.read_results(spark, str(tmp_path)).collect()


def test_last_numbers_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("episode 1\n0.25\n 0.75 \nend\n")
    assert [r.last_value for r in datasets.read_last_numbers(spark, str(tmp_path)).collect()] == [0.75]


def test_normaliser_statistics_document(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"state": {"default": {"global_min": [1, 2]}}, "action": {"arm": {"global_max": [3]}}}))
    got = {(r.group, r.key, r["name"], r["at"]): r.value for r in datasets.read_stats(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("state", "default", "global_min", 0): 1.0, ("state", "default", "global_min", 1): 2.0, ("action", "arm", "global_max", 0): 3.0}


def test_frames_are_pruned_by_episode(spark, tmp_path):
    rows = spark.createDataFrame([(e, i) for e in range(30) for i in range(3)], "episode_index long, frame_index long")
    datasets.write_frames(rows, str(tmp_path), chunk=10)
    some = datasets.read_frames(spark, str(tmp_path), episodes=[3, 27])
    assert some.count() == 6
    assert len(some.inputFiles()) >= 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "episode_index" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_report_and_matrix(spark, tmp_path):
    datasets.write_report(spark.createDataFrame([("a", 1)], "s string, n int"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().s == "a"
    assert datasets.task_matrix(spark, {"x": 2, "y": 0}).count() == 2


def test_episode_statistics(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    stats = {"action": {"min": [0.0], "max": [1.0], "mean": [0.5], "std": [0.1], "count": [4]}}
    (tmp_path / "meta" / "episodes_stats.jsonl").write_text(json.dumps({"episode_index": 3, "stats": stats}))
    row = datasets.read_episode_stats(spark, str(tmp_path)).first()
    assert (row.episode_index, row.feature, row["max"], row["count"]) == (3, "action", [1.0], [4])


def test_paths_and_completeness(spark, tmp_path):
    assert datasets.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        datasets.first_existing(spark, [str(tmp_path / "no")])
    rows = spark.createDataFrame([(e, i) for e in range(3) for i in range(2)], "episode_index long, frame_index long")
    datasets.write_frames(rows.filter("episode_index < 2"), str(tmp_path / "d"))
    assert [r[0] for r in datasets.incomplete_episodes(spark, str(tmp_path / "d"), rows).collect()] == [2]
    assert datasets.empty_table(spark, schema.table_schema(FEATURES)).count() == 0


def test_files_follow_the_bytes_and_not_the_episodes(spark):
    """All 15 episodes are stored in at most one file a task (F3, F4)."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = tables.parquet_roundtrip(spark, "/root/testdata/sf0.001")
    assert back.select("episode_index").distinct().count() > most >= len(back.inputFiles())
    lost = metadata.missing_files(spark, "/root/testdata/sf0.001")
    assert len(lost.inputFiles()) <= most + 1 and sorted(r[0] for r in lost.collect()) == [0, 5, 10]


def test_unstored_episodes_with_odd_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(e, i) for e in (-3, 0, 7, 10**12) for i in range(3)], "episode_index long, frame_index long")
    datasets.write_packed(rows.filter("episode_index IN (-3, 7)"), str(tmp_path), files=3)
    assert sorted(r[0] for r in datasets.unstored_episodes(spark, str(tmp_path), rows).collect()) == [0, 10**12]
