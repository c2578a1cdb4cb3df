"""Totals of the points that lie in spans, without a row for each point of a span.

Points and both ends of the spans are put in one order (by group, then place) and dealt into ranges; each range is read in
chunks of at most ``CHUNK`` rows.  A span that begins and ends in one chunk is summed there.  Any other takes the rest of its
first chunk, the beginning of its last one, and the whole chunks in between, which are a suffix and a prefix of two neighbouring
blocks of 2**k chunks: both are looked up in a table of all chunks and levels.  Nothing is subtracted, so totals are as exact as sums.

Scale.  Three rows a span and one a point are shuffled, however many points a span holds.  Equal places are dealt over ranges,
too.  The table has rows / ``CHUNK`` * levels rows; its largest window is half of all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.storage import broadcast_within, materialize

CHUNK = 8192
BROADCAST_ROWS = 200_000
NONE = np.iinfo("i8").max
BEGIN, END, POINT, INNER, WHOLE = range(5)

_OUT = "kind int, span long, key long, chunk long, n long, total double, least long"


def _sums(count: np.ndarray, valued: np.ndarray, value: np.ndarray, least: np.ndarray, at: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
    """Sums over [at, upto), which must not be empty."""
    order = np.argsort(at, kind="stable")
    pairs = np.ravel(np.column_stack([at[order], upto[order]]))
    back = np.argsort(order, kind="stable")
    folds = (np.add, count), (np.add, valued), (np.add, value), (np.minimum, least)
    return [f.reduceat(np.append(x, x[:1]), pairs)[::2][back] if len(at) else x[:0] for f, x in folds]


def _before(count: np.ndarray, valued: np.ndarray, value: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """Sums of all places before each, and before the end."""
    summed = [np.concatenate([[0], np.cumsum(x)]) for x in (count, valued, value)]
    return [*summed, np.concatenate([[NONE], np.minimum.accumulate(least)])]


def _chunk(chunk: int, kind: np.ndarray, ident: np.ndarray, key: pa.Array, known: np.ndarray, value: np.ndarray, valued: np.ndarray) -> pa.RecordBatch:
    """What one chunk gives: spans that lie in it, parts of others, and its own totals."""
    point = kind == POINT
    count, valued = point.astype("i8"), (valued & point).astype("i8")
    of = count, valued, np.where(valued, value, 0.0), np.where(point & known, ident, NONE)
    begins, ends = np.flatnonzero(kind == BEGIN), np.flatnonzero(kind == END)
    _, b, e = np.intersect1d(ident[begins], ident[ends], assume_unique=True, return_indices=True)
    open_, shut = np.delete(begins, b), np.delete(ends, e)
    inner = _sums(*of, begins[b], ends[e])
    prefix, suffix = _before(*of), [x[::-1] for x in _before(*(x[::-1] for x in of))]
    parts = [(BEGIN, open_, [x[open_] for x in suffix]), (END, shut, [x[shut] for x in prefix]), (INNER, begins[b], inner)]
    sums = [np.concatenate([*(p[2][k] for p in parts), prefix[k][-1:]]) for k in range(4)]
    where = np.concatenate([p[1] for p in parts])
    kinds = np.concatenate([*(np.full(len(p[1]), p[0], "i4") for p in parts), [WHOLE]]).astype("i4")
    columns = [
        pa.array(kinds),
        pa.array(np.append(ident[where], 0)),
        pa.concat_arrays([key.take(pa.array(where)), pa.nulls(1, pa.int64())]),
        pa.array(np.full(len(kinds), chunk, "i8")),
        pa.array(sums[0]),
        pa.array(sums[2].astype("f8"), mask=sums[1] == 0),
        pa.array(sums[3], mask=sums[3] == NONE),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "span", "key", "chunk", "n", "total", "least"])


def _fold(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Columns of a batch: group, kind, ident, key, value."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        ident = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        valued = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        value = batch.column(4).fill_null(0.0).to_numpy(zero_copy_only=False)
        groups = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for first, last in zip(groups, groups[1:]):
            for a in range(first, last, size):
                b = min(a + size, last)
                yield _chunk(chunk, kind[a:b], ident[a:b], batch.column(3).slice(a, b - a), known[a:b], value[a:b], valued[a:b])
                chunk += 1


def _plus(a: Column, b: Column) -> Column:
    """The sum of those that are not null."""
    return F.coalesce(a + b, a, b)


def _blocks(chunks: DataFrame, levels: int) -> DataFrame:
    """level, place and the sums from each chunk to the end of its block of 2**level chunks, and from the block's begin up to it."""
    dealt = chunks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    dealt = dealt.withColumn("block", F.expr("shiftright(place, level)"))
    block = Window.partitionBy("level", "block").rowsBetween(Window.unboundedPreceding, 0)
    sides = {"head": block.orderBy("place"), "tail": block.orderBy(F.desc("place"))}
    sums = {"n": F.sum, "total": F.sum, "least": F.min}
    return dealt.select("level", "place", *[f(c).over(w).alias(f"{side}_{c}") for side, w in sides.items() for c, f in sums.items()])


def totals(
    spans: DataFrame, points: DataFrame, by: str, key: str, span: tuple[str, str], at: str, value: str, ident: str, size: int = CHUNK
) -> DataFrame:
    """key, n, total, least of every span: number, sum of ``value`` and least ``ident`` of the points with its ``by`` in [begin, end).

    Ends and ``at`` are whole numbers, ``key`` and ``ident`` too.  Spans without a point, and those that are empty or have a null in
    ``by`` or an end, give no row or one with n = 0; nulls of ``value`` count, but add nothing.  A key may be there repeatedly.
    """
    fine = spans.filter(F.col(by).isNotNull() & (F.col(span[0]) < F.col(span[1])))
    fine = fine.select(F.col(by).alias("by"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("long").alias(n) for c, n in zip(span, ("a", "b"))])
    marked = materialize(fine.withColumn("ident", F.monotonically_increasing_id()), "spans")
    none, no = F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("key")
    rows = marked.select("by", F.col("a").alias("at"), F.lit(BEGIN).alias("kind"), "ident", "key", none)
    rows = rows.union(marked.select("by", F.col("b").alias("at"), F.lit(END).alias("kind"), "ident", no, none))
    told = points.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    rows = rows.union(told.select(F.col(by).alias("by"), F.col(at).cast("long"), F.lit(POINT), F.col(ident).cast("long"), no, F.col(value).cast("double")))
    order = ["by", "at", "kind", "ident"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("by", "kind", "ident", "key", "value")
    out = materialize(sorted_.mapInArrow(partial(_fold, size=size), _OUT), "chunks")

    part, number = F.expr("shiftright(chunk, 32)"), F.expr("chunk & 4294967295L")
    whole = out.filter(F.col("kind") == WHOLE).select(part.alias("part"), number.alias("number"), "n", "total", "least")
    counts = whole.groupBy("part").agg(F.count("*").alias("held"))  # one row a task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select("part", "held", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base")), "chunk-counts")
    chunks = base.agg(F.sum("held")).first()[0] or 0
    placed = whole.join(F.broadcast(base), "part").select((F.col("base") + F.col("number")).alias("place"), "n", "total", "least")
    table = broadcast_within(materialize(_blocks(placed, max(1, chunks.bit_length())), "chunk-blocks"), BROADCAST_ROWS)

    halves = out.filter(F.col("kind").isin(BEGIN, END)).select("kind", "span", "key", part.alias("part"), number.alias("number"), "n", "total", "least")
    halves = halves.join(F.broadcast(base.drop("held")), "part").withColumn("place", F.col("base") + F.col("number"))
    met = halves.groupBy("span").agg(
        F.max("key").alias("key"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"),
        (F.min("place") + 1).alias("lo"), (F.max("place") - 1).alias("hi"),
    )
    level = F.when(F.col("lo") < F.col("hi"), F.char_length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - 1).otherwise(0)
    met = met.withColumns({"level": level, "lo": F.when(F.col("lo") <= F.col("hi"), F.col("lo")), "hi": F.when(F.col("lo") < F.col("hi"), F.col("hi"))})
    for side, end in (("tail", "lo"), ("head", "hi")):
        there = table.select("level", F.col("place").alias(end), *[F.col(f"{side}_{c}") for c in ("n", "total", "least")])
        met = met.join(there, ["level", end], "left")
    n, total, least = (reduce_([F.col(c), F.col(f"tail_{c}"), F.col(f"head_{c}")]) for c, reduce_ in (("n", _sum), ("total", _sum), ("least", lambda x: F.least(*x))))
    combined = met.select("key", n.alias("n"), total.alias("total"), least.alias("least"))
    return combined.union(out.filter(F.col("kind") == INNER).select("key", "n", "total", "least"))


def _sum(columns: list[Column]) -> Column:
    a, b, c = columns
    return _plus(_plus(a, b), c)
