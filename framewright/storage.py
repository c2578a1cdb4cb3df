"""Scratch tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a narrow table and reading
it again.  The folder is the session's ``spark.checkpoint.dir``; only where
that is unset (tests, notebooks) a local one is used.  Tables last as long as the
session, unless they are written within ``scratch``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_passing: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)
#: Shuffle files go when the write that they serve has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else, on one machine, a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (configured or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/framewright-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (passing := _passing.get()) is not None:
        passing.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which no other table may still need."""
    path = _path_of.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if (spark, path) in _written:
        delete_path(spark, path)
        _written.remove((spark, path))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes meanwhile are deleted at the end, but those handed to what this yields.

    What is built on a deleted table can't run any more.  Kept tables are left to the next ``scratch`` around this one.
    """
    mine: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_path_of[df])
        return df

    token = _passing.set(mine)
    try:
        yield keep
    finally:
        _passing.reset(token)
        for spark, path in mine:
            if path not in kept:
                _delete(spark, path)
            elif (around := _passing.get()) is not None:
                around.append((spark, path))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the JVM may be gone already; nothing is lost but disk
            continue


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` (an already written table) has at most ``rows`` rows.

    Beyond that the plan is left to Catalyst, which shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df
