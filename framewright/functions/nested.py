"""Nested values rewritten leaf by leaf: structs, arrays and maps keep their shape, and everything stays an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Leaf = Callable[[Column, T.DataType], Column]


def map_leaves(value: Column, kind: T.DataType, f: Leaf) -> Column:
    """``value``, of type ``kind``, with ``f`` of each leaf (and its type) in its place; what is null as a whole stays null.

    Keys of maps are no leaves.
    """
    if isinstance(kind, T.StructType):
        made = F.struct(*[map_leaves(value[x.name], x.dataType, f).alias(x.name) for x in kind])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_leaves(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: map_leaves(x, kind.valueType, f))
    return f(value, kind)


def split_leaves(value: Column, kind: T.DataType, parts: dict[str, Leaf]) -> dict[str, Column]:
    """For each part, the nested value whose leaves are what that part takes of them."""
    return {name: map_leaves(value, kind, f) for name, f in parts.items()}


def reduce_leaves(values: list[Column], kind: T.DataType, f: Callable[[list[Column], T.DataType], Column]) -> Column:
    """One nested value from several of the type ``kind``: each leaf is ``f`` of theirs.

    Arrays are met place by place, up to the longest; maps by the keys of the first.  A struct that is null in all is null.
    """
    if isinstance(kind, T.StructType):
        made = F.struct(*[reduce_leaves([v[x.name] for v in values], x.dataType, f).alias(x.name) for x in kind])
        return F.when(F.coalesce(*values).isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        names = [f"v{k}" for k in range(len(values))]
        zipped = F.arrays_zip(*[v.alias(n) for v, n in zip(values, names, strict=True)])
        return F.transform(zipped, lambda z: reduce_leaves([z[n] for n in names], kind.elementType, f))
    if isinstance(kind, T.MapType):
        first, *others = values
        return F.transform_values(first, lambda k, x: reduce_leaves([x, *[F.try_element_at(o, k) for o in others]], kind.valueType, f))
    return f(values, kind)


def numbers_only(f: Callable[[Column], Column]) -> Leaf:
    """A leaf function that applies ``f`` to numbers and leaves other leaves alone."""
    return lambda x, kind: f(x) if isinstance(kind, T.NumericType) else x


def concatenated(value: Column, kind: T.StructType) -> Column:
    """The array leaves of a struct, one after another in the order of its fields."""
    found: list[Column] = []

    def gather(v: Column, k: T.DataType) -> None:
        if isinstance(k, T.StructType):
            for x in k:
                gather(v[x.name], x.dataType)
        else:
            found.append(v if isinstance(k, T.ArrayType) else F.array(v))

    gather(value, kind)
    return F.concat(*found)
