"""Scalars of training schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def flow_shift(u: Column, shift: float) -> Column:
    return shift * u / (1.0 + (shift - 1.0) * u)


def bell(t: Column, steps: float, centre: float = 0.5) -> Column:
    """A Gaussian over ``t`` of ``steps``, before it is shifted and scaled on the grid."""
    return F.exp(-2.0 * F.pow((t - steps * centre) / steps, F.lit(2)))


def interpolate(x: Column, noise: Column, s: Column) -> Column:
    return (1.0 - s) * x + s * noise


def velocity(x: Column, noise: Column) -> Column:
    return noise - x


def euler_step(x: Column, v: Column, now: Column, after: Column) -> Column:
    return x + v * (after - now)


def cosine_knee(step: Column, knee: int, total: int, start: float, end: float) -> Column:
    """``start`` up to the knee, then a cosine down to ``end``."""
    part = F.least(F.lit(1.0), (step - knee) / float(total - knee))
    return F.when(step < knee, F.lit(start)).otherwise(end + (start - end) * 0.5 * (1.0 + F.cos(part * math.pi)))


def linear_ramp(step: Column, begin: float, total: int) -> Column:
    """0 up to ``begin``, then evenly to 1 at ``total``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - begin) / max(1.0, total - begin)))


def learning_rate(step: Column, total: int, base: float, warmup: int, floor: float = 0.01) -> Column:
    """From base / warmup evenly to the base, then a cosine to ``floor`` of it."""
    warmup = min(max(warmup, 0), total - 1)
    remaining = max(total - warmup, 1)
    cosine = base * floor + base * (1 - floor) * 0.5 * (1.0 + F.cos((step - warmup) / float(remaining) * math.pi))
    if not warmup:
        return cosine
    rising = base * (1.0 / warmup + (1.0 - 1.0 / warmup) * step / float(warmup))
    return F.when(step < warmup, rising).otherwise(cosine)


def steps_per_epoch(rows: Column, batch: int, processes: int = 1, accumulate: int = 1) -> Column:
    per_process = F.ceil(rows / float(batch * processes))
    return F.ceil(per_process / float(accumulate))


def ceil_to(x: Column, multiple: int = 16) -> Column:
    return F.ceil(x / float(multiple)) * multiple


def frames_to_groups(t: Column) -> Column:
    """Counts of the form 4k + 1 stay; others go up to one by (t + 3) div 4 * 4 + 1."""
    return F.when(t % 4 == 1, t).otherwise(F.floor((t + 3) / 4) * 4 + 1).cast("long")


def window_frames(n: Column, ratio: int) -> Column:
    return F.floor((n - 1) / ratio) + 1


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the rate so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))
