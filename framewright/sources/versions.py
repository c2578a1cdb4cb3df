"""Tables that are replaced as a whole: readers see the last version that was finished, and nothing of one being written.

A version's rows go to a folder of their own.  What makes them count is a small file, created under the version's number
where none was, that names the folder; so of two writers of a version one wins, and a writer that dies leaves no version.
That needs no renaming and holds on object stores too.  A number that is there already is left alone, so a batch that is
delivered twice counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewright.storage import delete_path

MARKS = "_versions"


def _store(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def finished(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbers of the finished versions, and their folders."""
    files, marks = _store(spark, f"{root}/{MARKS}")
    out = {}
    for status in files.listStatus(marks) if files.exists(marks) else ():
        opened = files.open(status.getPath())
        told = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        opened.close()
        if told.endswith("\n"):  # else its writer has died, or is not done
            out[int(status.getPath().getName())] = f"{root}/{told.strip()}"
    return out


def latest(spark: SparkSession, root: str) -> int | None:
    return max(finished(spark, root), default=None)


def commit(df: DataFrame, root: str, version: int) -> bool:
    """Write ``df`` as a version; False, and nothing is written, if the version is there."""
    spark = df.sparkSession
    if version in finished(spark, root):
        return False
    folder = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    files, mark = _store(spark, f"{root}/{MARKS}/{version:012d}")
    if files.exists(mark) and version not in finished(spark, root):
        files.delete(mark, False)  # of a writer that died at this point
    try:
        out = files.create(mark, False)
    except Exception:
        if version in finished(spark, root):  # another writer was first
            delete_path(spark, f"{root}/{folder}")
            return False
        raise
    out.writeBytes(folder + "\n")
    out.close()
    return True


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A finished version, by default the last."""
    found = finished(spark, root)
    chosen = max(found, default=None) if version is None else version
    if chosen not in found:
        raise FileNotFoundError(f"{root} has no finished version" + ("" if version is None else f" {version}"))
    return spark.read.parquet(found[chosen])


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions: their marks first, so that no reader takes up rows that go."""
    found = finished(spark, root)
    for version in sorted(found)[: -keep or None]:
        delete_path(spark, f"{root}/{MARKS}/{version:012d}")
        delete_path(spark, found[version])
