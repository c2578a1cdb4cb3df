"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.storage import broadcast_within, materialize

BROADCAST_ROWS = 100_000
HOT_ROWS = 1_000
HOT_SHARE = 1e-5


def join_keyed(rows: DataFrame, keyed: DataFrame, on: str | list[str], how: str = "inner", size: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, a written table of one row per key and in ``size`` the rows of that key; no nulls.

    Few keys are broadcast.  Of many, the hot ones are: those of at least ``HOT_ROWS`` rows and a share of
    ``HOT_SHARE`` of all, so at most 1 / HOT_SHARE keys at any size.  The rest is dealt by key.
    """
    names = [on] if isinstance(on, str) else on
    count, total = keyed.agg(F.count("*"), F.sum(size)).first()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed.drop(size)), names, how)
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    few = materialize(keyed.filter(F.col(size) > least).drop(size), "hot-keys")
    cold = keyed.filter(F.col(size) <= least).drop(size)
    if few.isEmpty():
        return rows.join(cold, names, how)
    few = broadcast_within(few, int(1 / HOT_SHARE))
    rest = rows.join(few.select(*names), names, "left_anti").join(cold, names, how)
    return rows.join(few, names).unionByName(rest)
