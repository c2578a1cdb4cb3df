"""Columns of a frame table by their role: chosen and renamed, passed through, and masked by group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that begin so belong to a declared group.
CLAIMED = ("observation", "action")


def quoted(name: str) -> str:
    """A name with dots as one column."""
    return f"`{name}`"


def select_renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns ``names`` asks for (new name: column); fails if the table lacks one."""
    lacks = [c for c in names.values() if c not in df.columns]
    if lacks:
        raise ValueError(f"the table lacks {lacks}")
    return df.select(*[F.col(quoted(c)).alias(n) for n, c in names.items()])


def pass_through(columns: Iterable[str]) -> list[str]:
    """Names that no group claims, in order."""
    return [c for c in columns if not c.startswith(CLAIMED)]


def group_masks(df: DataFrame, groups: dict[str, list[str]], suffix: str = "_is_pad") -> DataFrame:
    """``df`` with one mask a group, that of its first key."""
    return df.withColumns({f"{g}{suffix}": F.col(quoted(f"{keys[0]}{suffix}")) for g, keys in groups.items()})
