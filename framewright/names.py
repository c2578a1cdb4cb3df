"""Names for columns that are needed for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``rows`` has, whatever its case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
