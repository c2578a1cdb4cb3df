"""Vectors in array columns: assembled, padded, split, and taken relative to a first step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(names: list[str]) -> Column:
    """Named scalars as a vector."""
    return F.array(*[F.col(n).cast("double") for n in names])


def as_vector(x: Column, width: int, scalar: bool = False) -> Column:
    """A scalar as a vector of one; fails if the width is not as declared."""
    v = F.array(x) if scalar else x
    fail = F.raise_error(F.lit(f"a vector is not {width} wide")).cast("array<double>")
    return F.when(F.size(v) == width, v.cast("array<double>")).otherwise(fail)


def concat_parts(parts: list[Column]) -> Column:
    return F.concat(*parts)


def pad_right(v: Column, width: int) -> Column:
    """Zeros up to the width."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))


def pad_mask(size: Column, width: int) -> Column:
    """True for the dims that ``pad_right`` adds."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: j >= size)


def split_parts(v: Column, widths: dict[str, int]) -> dict[str, Column]:
    """Consecutive slices of the declared widths, by name."""
    out, at = {}, 1
    for name, width in widths.items():
        out[name] = F.slice(v, at, width)
        at += width
    return out


def relative_to(chunk: Column, state: Column) -> Column:
    """A chunk of scalars less the state's first step."""
    return F.transform(chunk, lambda x: x - F.element_at(state, 1))


def absolute_from(chunk: Column, state: Column) -> Column:
    return F.transform(chunk, lambda x: x + F.element_at(state, 1))


def zero_padded(values: Column, padded: Column, delta_dim: bool = True) -> Column:
    """Zero where padded, if the dim holds deltas."""
    return F.transform(values, lambda x, i: F.when(F.lit(delta_dim) & F.get(padded, i), 0.0).otherwise(x))


def drop_last(v: Column) -> Column:
    return F.slice(v, 1, F.size(v) - 1)


def fit_cameras(cameras: Column, count: int, blank: Column) -> Column:
    """As many cameras as asked: blanks added, or the last left out."""
    return F.slice(F.concat(cameras, F.array_repeat(blank, F.greatest(F.lit(count) - F.size(cameras), F.lit(0)))), 1, count)


def axis_angle(q: Column) -> Column:
    """A quaternion (x, y, z, w) as axis times angle; zero for no turn."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.element_at(q, 4)))
    sine = F.sqrt(F.greatest(F.lit(0.0), 1.0 - w * w))
    turn = F.when(sine > 0, 2.0 * F.acos(w) / sine).otherwise(0.0)
    return F.transform(F.slice(q, 1, 3), lambda x: x * turn)


def gripper(g: Column, invert: bool = False, binary: bool = True) -> Column:
    """From [0, 1] to [-1, 1], turned round if asked, then to its sign (0 counts as 1)."""
    y = 2.0 * g - 1.0
    y = F.when(y >= 0, 1.0).otherwise(-1.0) if binary else y
    return -y if invert else y
