"""Frames that come one by one, kept until their episode ends and then handed on as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAMES = "episode long, frame_index long, seconds double, order_key long, task string, ended_by string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def episode_buffer(fps: float, idle_ms: int) -> StatefulProcessor:
    """A processor that Spark's own driver-side worker can load, too: a class within a function travels whole, and needs no import there."""

    class EpisodeBuffer(StatefulProcessor):
        """State of an episode: its frames so far, the time after which it counts as idle, and the time of its one timer, which may be earlier.

        A row with ``ends`` closes its episode; so does a watermark ``idle_ms`` past its last frame.  Then its frames go out in the order
        of ``order_key``, numbered from 0, and nothing of it is kept: a later frame of that name begins an episode anew.  Frames
        are stored as they come; only at the end does a task hold those of one episode.
        """

        def __init__(self, fps: float, idle_ms: int):
            self.fps, self.idle_ms = fps, idle_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.frames = handle.getListState("frames", "order_key long, task string")
            self.due = handle.getValueState("due", "at long, timer long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            ended, newest = False, -1
            for batch in rows:
                ends = batch["ends"].to_numpy(bool)
                ended = ended or bool(ends.any())
                newest = max(newest, int(batch["at_ms"].to_numpy().max()))
                frames = batch[~ends] if ends.any() else batch
                if len(frames):
                    self.frames.appendList(list(zip(frames["order_key"].tolist(), frames["task"].tolist(), strict=True)))
            held = self.due.get()
            if ended:
                if held is not None:
                    self.handle.deleteTimer(int(held[1]))
                yield from self._out(key, "end")
                return
            due = newest + self.idle_ms
            if held is None:
                self.handle.registerTimer(due)
                self.due.update((due, due))
            elif due > held[0]:
                self.due.update((due, int(held[1])))  # its timer looks again when it expires

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            due = int(self.due.get()[0])
            if due < timerValues.getCurrentWatermarkInMs() or due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._out(key, "idle")
                return
            self.handle.registerTimer(due)
            self.due.update((due, due))

        def _out(self, key, ended_by: str) -> Iterator[pd.DataFrame]:
            held = sorted((tuple(f) for f in self.frames.get()), key=lambda f: f[0])
            self.frames.clear()
            self.due.clear()
            if held:
                n = len(held)
                order_key, task = zip(*held, strict=True)
                place = range(n)
                yield pd.DataFrame(
                    {"episode": [int(key[0])] * n, "frame_index": place, "seconds": [k / self.fps for k in place], "order_key": order_key, "task": task, "ended_by": [ended_by] * n}
                )

        def close(self) -> None:
            pass

    return EpisodeBuffer(fps, idle_ms)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need this store; queries started meanwhile keep it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def episodes(stream: DataFrame, fps: float, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """The frames of ended episodes (columns of ``FRAMES``).

    ``stream`` has episode (long), at (time), order_key (long, the order within an episode), task (string) and ends (boolean;
    such a row carries no frame).  Frames later than the watermark, ``delay`` behind the newest, are dropped by Spark.
    Queries must be started within ``rocks``.
    """
    from pyspark.sql import functions as F

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = stream.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("episode").transformWithStateInPandas(episode_buffer(fps, idle_ms), FRAMES, "Append", "eventTime")
