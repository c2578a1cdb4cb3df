"""Workers and executors outlive their tasks and stages; what these have freed goes back to the system when they end."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession


def release() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, a generator over batches, with ``release`` at its end."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def give_back(spark: SparkSession) -> None:
    """Have the executors collect their garbage, so that heap and buffers that earlier stages filled are free for Python workers.

    A JVM keeps what it once took until it collects the whole heap, and it does so only when that is full.  Two tasks a core are
    sent; an executor that gets none keeps its heap.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc')")
    collected.write.format("noop").mode("overwrite").save()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, held: int = 4 << 20) -> Iterator[None]:
    """Hand tasks at most so many rows and about so many bytes at a time while this lasts, for rows that are wide."""
    by_rows, by_bytes = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    before = {name: spark.conf.get(name) for name in (by_rows, by_bytes)}
    most = int(before[by_rows])
    spark.conf.set(by_rows, min(rows, most) if most > 0 else rows)
    spark.conf.set(by_bytes, held)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
