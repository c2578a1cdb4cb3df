"""Intervals that overlap, found by equal keys: no product of the two sides is formed.

An interval belongs to a class by its length: class c holds lengths up to ``unit`` * 2**c.  Time is cut into bins of that width,
so an interval lies in two bins of its class at most, however long it is.  Of two intervals that overlap, the longer one's class
decides where they meet; so an interval is put into the bins of its own class and of the higher classes that the other side
has, at most two each.  The pair is taken in the later of their first common bins only, so it is never there twice.

Groups of ``by`` with few rows on the right side (``LIGHT``, or ``hot`` if that is less) are not cut into bins: their rows meet by
``by`` alone, which compares at most so many pairs a row of the left side and shuffles each row once.

Scale.  The rows put into bins are at most 2 * classes (about the logarithm of longest to shortest) an interval.  Bins
with more than ``hot`` intervals of the right side are split: these are dealt into parts by hash, and the left side's rows of
that bin meet each part.  The counts of bins are summed before they are shuffled; hot bins are at most rows / ``hot``, and are
broadcast only if they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.storage import broadcast_within, materialize

HOT = 10_000
LIGHT = 256
HEAVY_GROUPS = 100_000
BROADCAST_BINS = 100_000
LOWEST = -60


def length_class(begin: Column, end: Column, unit: float = 1.0) -> Column:
    """The least c for which the length is at most ``unit`` * 2**c; points are in the lowest class."""
    length = (end - begin).cast("double") / unit
    return F.when(length > 0, F.greatest(F.ceil(F.log2(length)).cast("int"), F.lit(LOWEST))).otherwise(LOWEST).cast("int")


def _binned(rows: DataFrame, begin: str, end: str, own: Column, classes: list[int], unit: float) -> DataFrame:
    """``rows`` with cls and bin, a row for each class not below its own and each bin of that class that it lies in."""
    width = lambda c: F.lit(unit) * F.pow(F.lit(2.0), c.cast("double"))
    place = lambda x, c: F.floor(F.col(x).cast("double") / width(c)).cast("long")
    chosen = F.filter(F.array(*map(F.lit, classes)), lambda c: c >= own)
    dealt = rows.withColumn("cls", F.explode(chosen))
    first, last = place(begin, F.col("cls")), place(end, F.col("cls"))
    return dealt.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlaps(
    left: DataFrame, right: DataFrame, by: str | None, left_span: tuple[str, str], right_span: tuple[str, str], unit: float = 1.0, hot: int = HOT
) -> DataFrame:
    """All pairs of rows with the same ``by`` whose spans [begin, end) share a moment; columns of both but one ``by``.

    ``left_span`` and ``right_span`` name the columns of begin and end, numbers of one unit; other column names of the two sides
    must differ.  A span that is empty (begin = end) is a point and meets the spans that hold it, and points equal to it.
    Rows with a null in ``by`` or a span, and spans that end before they begin, meet nothing.
    """
    shared = [by] if by else []
    clash = (set(left.columns) & set(right.columns)) - set(shared)
    if clash or {"cls", "bin", "part"} & {*left.columns, *right.columns}:
        raise ValueError(f"columns of both sides must differ: {sorted(clash)}")
    fine = lambda rows, span: rows.filter((F.col(span[0]) <= F.col(span[1])) & (F.col(by).isNotNull() if by else F.lit(True)))
    left, right = fine(left, left_span), fine(right, right_span)
    if not by:
        return _binned_pairs(left, right, by, left_span, right_span, unit, hot)
    heavy = right.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > min(LIGHT, hot)).select(by)
    heavy = materialize(heavy, "heavy-groups")
    if heavy.isEmpty():
        return left.join(right, by).filter(_share(left_span, right_span))
    few = broadcast_within(heavy, HEAVY_GROUPS)
    (light_l, heavy_l), (light_r, heavy_r) = ([side.join(few, by, how) for how in ("left_anti", "left_semi")] for side in (left, right))
    met = light_l.join(light_r, by).filter(_share(left_span, right_span))
    return met.unionByName(_binned_pairs(heavy_l, heavy_r, by, left_span, right_span, unit, hot))


def _share(left_span: tuple[str, str], right_span: tuple[str, str]) -> Column:
    x, y, u, v = (F.col(c) for c in (*left_span, *right_span))
    return ((x < v) & (u < y)) | ((x == y) & (u <= x) & (x < v)) | ((u == v) & (x <= u) & (u < y)) | ((x == y) & (u == v) & (x == u))


def _binned_pairs(
    left: DataFrame, right: DataFrame, by: str | None, left_span: tuple[str, str], right_span: tuple[str, str], unit: float, hot: int
) -> DataFrame:
    """The same pairs, met in bins."""
    shared = [by] if by else []
    own_l, own_r = (length_class(F.col(s[0]), F.col(s[1]), unit) for s in (left_span, right_span))
    # Points alone would have bins without width: they get those of the least class that is no point's.
    found = left.select(own_l.alias("c")).union(right.select(own_r.alias("c"))).distinct()
    classes = sorted(r.c for r in found.collect())  # at most as many as a length has binary digits
    real = [c for c in classes if c > LOWEST] or [0]
    lift = lambda own: F.greatest(own, F.lit(real[0]))
    a = _binned(left, *left_span, lift(own_l), real, unit)
    b = _binned(right, *right_span, lift(own_r), real, unit)
    keys = [*shared, "cls", "bin"]
    crowded = b.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    crowded = materialize(crowded.select(*keys, F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot-bins")
    few = broadcast_within(crowded, BROADCAST_BINS)
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(few, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    told = [c for c, kind in right.dtypes if "map<" not in kind and "variant" not in kind]
    b = b.join(few, keys, "left").withColumn("part", F.pmod(F.xxhash64(*told), parts).cast("int")).drop("parts")
    met = a.join(b, [*keys, "part"])
    later = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    width = F.lit(unit) * F.pow(F.lit(2.0), F.col("cls").cast("double"))
    once = (F.col("cls") == F.greatest(lift(own_l), lift(own_r))) & (F.col("bin") == F.floor(later.cast("double") / width))
    return met.filter(_share(left_span, right_span) & once).drop("cls", "bin", "part")
