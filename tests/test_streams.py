from __future__ import annotations

import datetime as dt
import os
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.sources import datasets, versions
from framewright.streaming import buffer, running, sessions


def test_version_is_there_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.latest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.commit(spark.range(5), root, 1) and not versions.commit(spark.range(50), root, 1)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(broken, root, 2)
    assert versions.latest(spark, root) == 1 and versions.read(spark, root).count() == 5
    mark = tmp_path / "t" / versions.MARKS / f"{2:012d}"
    mark.write_text("rows-of-a-writer-that-died")  # no line end: it was not finished
    assert versions.latest(spark, root) == 1
    assert versions.commit(spark.range(7), root, 2) and versions.read(spark, root).count() == 7
    assert versions.read(spark, root, 1).count() == 5
    versions.commit(spark.range(8), root, 3)
    versions.prune(spark, root, keep=2)
    assert sorted(versions.finished(spark, root)) == [2, 3] and len([d for d in os.listdir(tmp_path / "t") if d.startswith("rows-")]) >= 2
    versions.prune(spark, root, keep=0)
    assert versions.latest(spark, root) is None


def moments_of(values):
    n, mean = len(values), sum(values) / len(values)
    return n, mean, sum((v - mean) ** 2 for v in values), min(values), max(values)


def test_merged_moments_of_large_means(spark):
    """Squares of the values would leave no digit of the spread."""
    one, other = [1e9 + k for k in range(5)], [1e9 + 0.5 * k for k in range(7)]
    rows = lambda values, k: spark.createDataFrame([(k, v) for v in values], "k string, x double")
    a, b = rows(one, "s").union(rows([2.0], "a")), rows(other, "s").union(rows([3.0], None)).union(rows([None], "none"))
    got = running.merge_moments(running.moments(a, ["k"], "x"), running.moments(b, ["k"], "x"), ["k"])
    told = {r.k: (r["count"], r["mean"], r.m2, r["min"], r["max"]) for r in got.collect()}
    assert set(told) == {"s", "a", None}
    assert told["s"] == pytest.approx(moments_of(one + other), rel=1e-9) and told["a"] == (1, 2.0, 0.0, 2.0, 2.0)


def files(spark, path, parts):
    for rows, schema in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_a_batch_that_is_delivered_again_counts_once(spark, tmp_path):
    path, root, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/stats", str(tmp_path / "checkpoint")
    schema = "k long, x double"
    files(spark, path, [([(1, 1.0), (2, 5.0)], schema), ([(1, 3.0)], schema), ([(1, 8.0), (3, 4.0)], schema)])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    running.keep_statistics(stream(), ["k"], "x", root, checkpoint).awaitTermination()
    want = sorted(tuple(r) for r in running.statistics(spark, root).collect())
    assert versions.latest(spark, root) == 2
    # The engine dies after the batch counts, but before it writes that down: it delivers the batch again.
    for name in os.listdir(f"{checkpoint}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{checkpoint}/commits/{name}")
    running.keep_statistics(stream(), ["k"], "x", root, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in running.statistics(spark, root).collect()) == want
    files(spark, path, [([(3, 6.0)], schema)])
    running.keep_statistics(stream(), ["k"], "x", root, checkpoint).awaitTermination()
    told = {r.k: (r["count"], r["mean"]) for r in running.statistics(spark, root).collect()}
    assert told == {1: (3, 4.0), 2: (1, 5.0), 3: (2, 5.0)}


HOUR = dt.timedelta(hours=1)
BEGAN = dt.datetime(2024, 1, 1)


def test_buffer_commits_whole_episodes_and_forgets_them(spark, tmp_path):
    schema = "episode long, at timestamp, order_key long, task string, ends boolean"
    frame = lambda e, h, k: (e, BEGAN + h * HOUR, k, f"t{k}", False)
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    files(
        spark,
        path,
        [
            ([frame(1, 0, 2), frame(1, 0, 1), frame(2, 0, 5), frame(3, 0, 7)], schema),
            ([frame(1, 1, 3), (1, BEGAN + HOUR, 9, None, True), frame(2, 1, 4)], schema),
            ([frame(3, 2, 6), frame(1, 2, 11), (4, BEGAN + 2 * HOUR, 0, None, True)], schema),  # 1 begins anew; 4 ends without frames
            ([(9, BEGAN + 999 * HOUR, 0, None, True)], schema),
        ],
    )
    with buffer.rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = sessions.run_to_end(buffer.episodes(stream, 10.0, idle="90 minutes"), str(tmp_path / "out"), checkpoint)
        told = sorted((r.episode, r.frame_index, r.seconds, r.order_key, r.ended_by) for r in got.collect())
        assert told == sorted(
            [(1, 0, 0.0, 1, "end"), (1, 1, 0.1, 2, "end"), (1, 2, 0.2, 3, "end"), (1, 0, 0.0, 11, "idle"), (2, 0, 0.0, 4, "idle"), (2, 1, 0.1, 5, "idle")]
            + [(3, 0, 0.0, 6, "idle"), (3, 1, 0.1, 7, "idle")]
        )
        for variable in ("frames", "due"):
            state = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
            assert state.count() == 0


def test_late_rows_are_kept_apart_once(spark, tmp_path):
    schema = "k long, at timestamp"
    path, root, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/apart", str(tmp_path / "checkpoint")
    at = lambda k, h: (k, BEGAN + h * HOUR)
    files(spark, path, [([at(1, 0), at(2, 10)], schema), ([at(3, 7), at(4, 8), at(5, 12), (6, None)], schema), ([at(7, 9), at(8, 11)], schema)])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    sessions.split_late(stream(), "at", "2 hours", root, checkpoint).awaitTermination()
    late = lambda: sorted((r.k, r.batch) for r in sessions.late_rows(spark, root).collect())
    assert late() == [(3, 1), (7, 2)]
    for name in os.listdir(f"{checkpoint}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{checkpoint}/commits/{name}")
    sessions.split_late(stream(), "at", "2 hours", root, checkpoint).awaitTermination()
    assert late() == [(3, 1), (7, 2)] and spark.read.parquet(f"{root}/on_time").count() == 6


def test_sessions_end_with_the_watermark(spark, tmp_path):
    schema = "k string, at timestamp, x double"
    path = str(tmp_path / "in")
    at = lambda k, m: (k, BEGAN + dt.timedelta(minutes=m), 1.0)
    files(spark, path, [([at("a", 0), at("a", 20), at("a", 60), at("b", 5)], schema), ([at("z", 300)], schema), ([at("z", 301)], schema), ([at("a", 70), at("z", 302)], schema)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = sessions.sessions(stream, "k", "at", "30 minutes", "10 minutes", F.sum("x").alias("x"))
    got = sessions.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    told = sorted((r.k, int((r.begin - BEGAN).total_seconds() // 60), int((r.end - BEGAN).total_seconds() // 60), r["rows"], r.x) for r in got.collect())
    assert told == [("a", 0, 50, 2, 2.0), ("a", 60, 90, 1, 1.0), ("b", 5, 35, 1, 1.0)]  # a's row at 70 came too late; z is still open


def test_last_line_appended_counts_whatever_the_files_sizes(spark, tmp_path):
    root = str(tmp_path)
    for k, n in enumerate([3000, 2, 500]):
        rows = spark.range(n).select(F.lit(0).cast("long").alias("task_index"), F.concat(F.lit(f"{k}-"), F.col("id")).alias("task")).coalesce(1)
        datasets.append_jsonl(rows, f"{root}/meta/tasks.jsonl")
        time.sleep(0.05)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert [tuple(r) for r in datasets.read_tasks(spark, root).collect()] == [(0, "2-499")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_that_can_not_be_read_are_kept_apart(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": "one", "b": "x"}', '{"a": 2, "b"', "", "   ", '{"b": "y"}', '{"a": 3}', "nonsense", '{"a": 4, "b": "tab\there"}', "[]"]
    (tmp_path / "f.json").write_text("\n".join(lines))
    good, bad = datasets.read_apart(spark, str(tmp_path), "a long, b string", ["a"])
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (3, None), (4, "tab\there")]
    told = {r.line: r.fault for r in bad.collect()}
    assert told == {lines[1]: "not readable", lines[2]: "not readable", lines[5]: "lacks a", "nonsense": "not readable", "[]": told["[]"]}
    assert bad.first().path.endswith("f.json")
    shutil.rmtree(tmp_path / "none", ignore_errors=True)


def test_buffer_moves_no_timer_for_each_batch():
    """A later frame only writes down the later time; the one timer looks again when it expires."""
    calls = []

    class State:
        def __init__(self):
            self.value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def appendList(self, rows):
            self.value = (self.value or []) + rows

        def clear(self):
            self.value = None

    class Handle:
        def getListState(self, *_):
            return Frames()

        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Frames(State):
        def get(self):
            return iter(self.value or [])

    class At:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    made = buffer.episode_buffer(10.0, 100)
    made.init(Handle())
    batch = lambda at, ends=False: pd.DataFrame({"ends": [ends], "at_ms": [at], "order_key": [at], "task": ["t"]})
    for at in (0, 50, 90):
        assert list(made.handleInputRows((1,), iter([batch(at)]), None)) == []
    assert calls == [("register", 100)]
    assert list(made.handleExpiredTimer((1,), At(150), At(100))) == [] and calls[1:] == [("register", 190)]
    (out,) = made.handleExpiredTimer((1,), At(191), At(190))
    assert out["order_key"].tolist() == [0, 50, 90] and set(out["ended_by"]) == {"idle"}
    list(made.handleInputRows((1,), iter([batch(200)]), None))
    (out,) = made.handleInputRows((1,), iter([batch(210, ends=True)]), None)
    assert out["order_key"].tolist() == [200] and calls[2:] == [("register", 300), ("delete", 300)]
