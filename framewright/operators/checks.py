"""Checks that give the rows, or the settings, that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channels by pixel format or image mode; the first that the name contains holds.
CHANNELS = [
    ("gray", 1), ("depth", 1), ("monochrome", 1), ("rgba", 4), ("yuva", 4), ("rgb", 3), ("yuv", 3),
]

#: Channels by image mode.
MODES = {"L": 1, "LA": 2, "RGB": 3, "RGBA": 4}

#: The longest episode of each suite, in steps.
SUITE_STEPS = {"libero_spatial": 400, "libero_object": 400, "libero_goal": 400, "libero_10": 700, "libero_90": 700}


def bad_embeddings(rows: DataFrame, context: str, mask: str, length: int, width: int, *keys: str) -> DataFrame:
    """keys, fault of cached embeddings that are not ``length`` vectors of ``width`` with a mask as long."""
    fault = (
        F.when(F.col(context).isNull() | F.col(mask).isNull(), "missing")
        .when(F.size(context) != length, "context length")
        .when(F.exists(context, lambda v: F.size(v) != width), "context width")
        .when(F.size(mask) != length, "mask length")
    )
    return rows.select(*keys, fault.alias("fault")).filter("fault IS NOT NULL")


def single_value(rows: DataFrame, name: str) -> DataFrame:
    """One row: the value that all rows have; fails if they differ."""
    told = rows.agg(F.countDistinct(name).alias("__n"), F.first(name, ignorenulls=True).alias(name))
    fail = F.raise_error(F.concat(F.col("__n").cast("string"), F.lit(f" values of {name}"))).cast(rows.schema[name].dataType)
    return told.select(F.when(F.col("__n") <= 1, F.col(name)).otherwise(fail).alias(name))


def input_faults(frames: Column, height: Column, width: Column, actions: Column, actions_per_frame: int) -> Column:
    """What breaks the model's input rules: sides by 16, frames 4k + 1, actions divisible by the frames after the first."""
    rules = [
        F.when((height % 16 != 0) | (width % 16 != 0), F.lit("sides")),
        F.when(frames % 4 != 1, F.lit("frames")),
        F.when(actions != (frames - 1) * actions_per_frame, F.lit("actions")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def stats_faults(feature: Column, stat: Column, values: Column) -> Column:
    """What breaks the rules of statistics: no value at all, a count that is not one number, an image's that are not three."""
    return (
        F.when(values.isNull() | (F.size(values) == 0), "empty")
        .when((stat == "count") & (F.size(values) != 1), "count")
        .when((stat != "count") & F.contains(feature, F.lit("image")) & (F.size(values) != 3), "channels")
    )


def mask_faults(masks: DataFrame, widths: DataFrame, key: str, mask: str, width: str) -> DataFrame:
    """key, fault of masks that have no declared key, are missing, or are not as long as declared."""
    declared = F.when(F.col(width).isNull(), "unknown key")
    fault = declared.when(F.col(mask).isNull(), "missing").when(F.size(mask) != F.col(width), "length")
    met = masks.select(key, mask).join(widths.select(key, width), key, "full")
    return met.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def before_version(version: Column, gate: str) -> Column:
    """Whether a version such as v2.0 comes before the gate, number by number."""
    numbers = lambda v: F.transform(F.split(F.ltrim(v, F.lit("v")), r"\."), lambda x: x.cast("int"))
    return numbers(version) < numbers(F.lit(gate))


def over_length(masks: Column) -> Column:
    """Whether a prompt's mask is true throughout, as it is when the prompt was cut."""
    return F.forall(masks, lambda m: m)


def channels(pixel_format: Column) -> Column:
    """Channels of a pixel format; fails on an unknown one."""
    out = F.raise_error(F.concat(F.lit("unknown pixel format "), pixel_format)).cast("int")
    for name, n in reversed(CHANNELS):
        out = F.when(F.contains(F.lower(pixel_format), F.lit(name)), F.lit(n)).otherwise(out)
    return out


def of_table(word: Column, values: dict[str, int], what: str) -> Column:
    """The word's number in a fixed table; fails on a word that it lacks."""
    out = F.raise_error(F.concat(F.lit(f"unknown {what} "), word)).cast("int")
    for name, n in values.items():
        out = F.when(word == name, F.lit(n)).otherwise(out)
    return out


def mode_channels(mode: Column) -> Column:
    return of_table(mode, MODES, "image mode")


def suite_steps(suite: Column) -> Column:
    return of_table(suite, SUITE_STEPS, "suite")


def trial_state(trial: Column, states: Column) -> Column:
    """Which of the initial states a trial begins in."""
    return F.pmod(trial, states)


def canvas(widths: list[Column], heights: list[Column], layout: str) -> tuple[Column, Column]:
    """Width and height of cameras side by side or one above the other."""
    total = lambda xs: sum(xs[1:], xs[0])
    most = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    return (total(widths), most(heights)) if layout == "horizontal" else (most(widths), total(heights))
