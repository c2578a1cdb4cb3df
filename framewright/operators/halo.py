"""Windows over long episodes, cut into ranges that overlap as far as the window looks.

A window over an episode puts all its frames into one task.  Here an episode is cut into ranges of ``span`` frames; a frame goes
to its own range and, as a halo, to those whose frames look at it.  A range with its halo looks like an episode to the window:
where it ends, so does the episode, or nothing looks further.  Rows of halos are dropped afterwards.  The rows added are
about (before + after) / span of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.names import unused
from framewright.operators import temporal

SPAN = 100_000


def in_ranges(
    frames: DataFrame, episode: str, frame: str, before: int, after: int, apply: Callable[[DataFrame, str], DataFrame], span: int = SPAN
) -> DataFrame:
    """``apply`` to ``frames``, with the name of a column that holds the ranges in place of the episode's.

    ``before`` and ``after`` say how many frames back and on a row is looked at.  ``frame`` numbers frames from 0 without gaps.
    ``apply`` keeps the rows and their columns.
    """
    if min(before, after) < 0 or span < 1:
        raise ValueError("before and after must not be negative, nor a range empty")
    part, key = unused(frames, "range", "range_key")
    place = F.col(frame).cast("long")
    first = F.floor(F.greatest(place - after, F.lit(0)) / span).cast("long")
    last = F.floor((place + before) / span).cast("long")
    dealt = frames.withColumn(part, F.explode(F.sequence(first, last)))
    told = apply(dealt.withColumn(key, F.struct(F.col(episode), F.col(part))), key)
    return told.filter(F.floor(place / span) == F.col(part)).drop(part, key)


def delta_window(frames: DataFrame, value: str, deltas: list[int], episode: str, frame: str = "frame_index", span: int = SPAN) -> DataFrame:
    """``temporal.delta_window`` over ranges."""
    before, after = max(0, -min(deltas)), max(0, *deltas)
    return in_ranges(frames, episode, frame, before, after, lambda rows, key: temporal.delta_window(rows, value, deltas, key, frame), span)


def sliding_window(frames: DataFrame, value: str, width: int, episode: str, frame: str = "frame_index", span: int = SPAN) -> DataFrame:
    """``temporal.sliding_window`` over ranges."""
    return in_ranges(frames, episode, frame, 0, width - 1, lambda rows, key: temporal.sliding_window(rows, value, width, key, frame), span)


def irregular_steps(frames: DataFrame, time: str, step: float, tolerance: float, episode: str, frame: str = "frame_index", span: int = SPAN) -> DataFrame:
    """``temporal.irregular_steps`` over ranges."""
    return in_ranges(frames, episode, frame, 1, 0, lambda rows, key: temporal.irregular_steps(rows, time, step, tolerance, key, frame), span)
