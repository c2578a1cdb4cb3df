"""Linear normalisation of signals, and its inverse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 5.0
LEAST_RANGE = 1e-4
LEAST_STD = 1e-8


def zscore(mean: Column, std: Column) -> tuple[Column, Column]:
    """Scale and offset."""
    scale = 1.0 / (std + LEAST_STD)
    return scale, -mean * scale


def between(low: Column, high: Column) -> tuple[Column, Column]:
    """Scale and offset that take [low, high] to [-1, 1]; a range below the least is only shifted by ``low``."""
    width = high - low
    flat = width < LEAST_RANGE
    safe = F.when(flat, 1.0).otherwise(width)
    return F.when(flat, 1.0).otherwise(2.0 / safe), F.when(flat, -low).otherwise(-1.0 - low * 2.0 / safe)


def constant_range(mode: str) -> tuple[Column, Column]:
    """Scale and offset of a mode "low/high"."""
    low, high = map(float, mode.split("/"))
    return between(F.lit(low), F.lit(high))


def mode_of(key: str, default: str, exceptions: dict[str, str]) -> str:
    """A key's mode: its exception, else the default."""
    return exceptions.get(key, default)


def coefficients(mode: str, stats: dict[str, Column]) -> tuple[Column, Column]:
    """Scale and offset by mode: z-score, min/max, q01/q99, or "low/high"."""
    if mode == "z-score":
        return zscore(stats["mean"], stats["std"])
    if mode in ("min/max", "q01/q99"):
        low, high = mode.split("/")
        return between(stats[low], stats[high])
    return constant_range(mode)


def normalize(x: Column, scale: Column, offset: Column, limit: float = LIMIT) -> Column:
    """x * scale + offset within the limit; NaN stays."""
    y = x * scale + offset
    return F.when(F.isnan(y), y).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), y)))


def denormalize(y: Column, scale: Column, offset: Column) -> Column:
    return (y - offset) / scale


def adapter(mode: str, stats: dict[str, Column]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """One key's way in and way back."""
    scale, offset = coefficients(mode, stats)
    return lambda x: normalize(x, scale, offset), lambda y: denormalize(y, scale, offset)


def normalize_array(x: Column, scale: Column, offset: Column) -> Column:
    """The same for arrays of one width."""
    zipped = F.arrays_zip(x.alias("x"), scale.alias("s"), offset.alias("o"))
    return F.transform(zipped, lambda z: normalize(z["x"], z["s"], z["o"]))


def pixels_to_unit(x: Column) -> Column:
    return x.cast("double") / 255.0


def pixels_to_signed(x: Column) -> Column:
    return x.cast("double") * 2.0 / 255.0 - 1.0


def unit_to_pixels(x: Column) -> Column:
    """Truncated, as a cast to bytes does."""
    return (x * 255.0).cast("int")
