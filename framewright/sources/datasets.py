"""Episode datasets on disk: Parquet frames, JSON metadata, result logs; read and written with Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODES = "episode_index long, tasks array<string>, length long, raw_file_name string"
TASKS = "task_index long, task string"
RESULTS = (
    "task_suite string, task_id long, total_episodes long, gpu_id long, start_time string, successes long, "
    "success_episodes array<long>, failure_episodes array<long>, task_description string, duration double"
)
INFO = (
    "total_episodes long, total_frames long, total_tasks long, total_chunks long, chunks_size long, fps double, split_train string, "
    "features map<string,struct<dtype:string,shape:array<long>,names:array<string>>>"
)
#: Annotation tables of a dataset.
ANNOTATIONS = ["task", "coarse_task", "quality", "coarse_quality", "operating_hand", "atomic_task", "subtask"]


def read_frames(spark: SparkSession, root: str, schema: T.StructType | None = None, episodes: list[int] | None = None) -> DataFrame:
    """The frame table; with episodes named, files of other episodes are pruned by the partition column."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    frames = reader.parquet(f"{root}/data")
    return frames if episodes is None else frames.filter(F.col("episode_index").isin(episodes))


def write_frames(frames: DataFrame, root: str, chunk: int = 1000, mode: str = "overwrite") -> None:
    """An export: one folder per chunk and episode; rows of an episode meet in one task, one file each.

    Files are as many as episodes; ``write_packed`` stores any number of them.
    """
    chunked = frames.withColumn("episode_chunk", F.floor(F.col("episode_index") / chunk))
    chunked.repartition("episode_chunk", "episode_index").sortWithinPartitions("episode_index", "frame_index").write.mode(
        mode
    ).partitionBy("episode_chunk", "episode_index").parquet(f"{root}/data")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; control characters inside strings are allowed."""
    return spark.read.schema(schema).option("allowUnquotedControlChars", True).json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A JSON file that is one document."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("multiLine", True).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def line_order() -> Column:
    """The order in which lines were appended: by the time of their file, then its name, then the place in it.

    Row numbers only compare lines of one block of a file, which one task reads in order; blocks of all sizes are thus kept in
    order, whichever task reads them.
    """
    file = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_name", "file_block_start")]
    return F.struct(*file, F.monotonically_increasing_id().alias("line"))


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """task_index, task; of lines that repeat an index, the last one appended counts."""
    tasks = read_jsonl(spark, f"{root}/meta/tasks.jsonl", TASKS).select("*", line_order().alias("appended"))
    return tasks.groupBy("task_index").agg(F.max_by("task", "appended").alias("task"))


def read_apart(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """The JSON lines that read as ``schema`` and have all required fields, and the others: path, line, fault.

    A line that is no JSON, or has a field of another kind, is not readable.  Blank lines are no lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter("trim(line) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable", "allowUnquotedControlChars": "true"}
    read = lines.withColumn("read", F.from_json("line", f"{schema}, unreadable string", options))
    lacking = F.filter(F.array(*[F.when(F.col(f"read.{c}").isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
    fault = F.when(F.col("read.unreadable").isNotNull() | F.col("read").isNull(), "not readable").when(
        F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", "))
    )
    told = read.withColumn("fault", fault)
    names = [f"read.{f.name}" for f in T.StructType.fromDDL(schema)]
    return told.filter("fault IS NULL").select(*names), told.filter("fault IS NOT NULL").select("path", "line", "fault")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/meta/episodes.jsonl", EPISODES)


def write_document(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_info(counts: DataFrame, features: dict[str, dict], root: str) -> None:
    """The info document: a dataset's counts (one row, as ``info_document`` gives) with its declared features."""
    declared = [
        F.struct(
            F.lit(f["dtype"]).alias("dtype"),
            F.array(*map(F.lit, f["shape"])).alias("shape"),
            F.array(*map(F.lit, f.get("names") or [])).cast("array<string>").alias("names"),
        )
        for f in features.values()
    ]
    named = F.struct(*[d.alias(n) for n, d in zip(features, declared, strict=True)])
    write_document(counts.withColumn("features", named), f"{root}/meta/info.json")


def read_info(spark: SparkSession, root: str) -> DataFrame:
    """The info document, one row; ``features`` maps names to dtype, shape and names."""
    return read_document(spark, f"{root}/meta/info.json", INFO)


def write_episode_stats(stats: DataFrame, root: str) -> None:
    """One line an episode from rows of episode_index, feature, min, max, mean, std, count, as ``read_episode_stats`` gives."""
    entry = F.struct("feature", F.struct("min", "max", "mean", "std", "count").alias("s"))
    lines = stats.groupBy("episode_index").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("stats"))
    append_jsonl(lines, f"{root}/meta/episodes_stats.jsonl")


def write_stats(rows: DataFrame, path: str) -> None:
    """A normaliser's statistics document from rows of group, key, name, at, value; it holds declared features only."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"].cast("float"))
    by_name = rows.groupBy("group", "key", "name").agg(ordered.alias("values"))
    by_key = by_name.groupBy("group", "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("stats"))
    keys = lambda g: F.map_from_entries(F.collect_list(F.when(F.col("group") == g, F.struct("key", "stats")))).alias(g)
    write_document(by_key.agg(keys("state"), keys("action")), path)


def read_task_list(spark: SparkSession, path: str) -> DataFrame:
    """task, first_place of each key of a flat list "key: value"; comments and blank lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "line"))
    keyed = lines.select("place", F.regexp_extract("line", r"^([^\s#:][^:#]*?)\s*:", 1).alias("task")).filter("task <> ''")
    return keyed.groupBy("task").agg(F.min("place").alias("first_place"))


def read_annotations(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All annotation tables; each must be there."""
    return {k: read_jsonl(spark, f"{root}/annotations/{k}.jsonl", f"{k}_index long, {k} string") for k in ANNOTATIONS}


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Result documents of all workers; one that lacks a required field fails."""
    found = spark.read.schema(RESULTS).option("multiLine", True).json(f"{root}/*/gpu*_task*_results.json")
    required = ["task_suite", "task_id", "successes", "total_episodes", "duration"]
    lacks = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()), ", ")
    fail = F.raise_error(F.concat(F.lit("a result lacks "), lacks)).cast("string")
    return found.withColumn("task_suite", F.when(lacks == "", F.col("task_suite")).otherwise(fail))


def read_last_numbers(spark: SparkSession, path: str) -> DataFrame:
    """path, last_value: the last line of each text file under ``path`` that reads as a number.

    Lines are rows, so a log of any length is read in blocks; of each block one row a file goes on.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    number = F.trim(F.col("value")).try_cast("double")
    each = lines.select(F.col("_metadata.file_path").alias("path"), line_order().alias("at"), number.alias("v"))
    return each.filter("v IS NOT NULL").groupBy("path").agg(F.max_by("v", "at").alias("last_value"))


def _files(spark: SparkSession, root: str) -> tuple[DataFrame, Column]:
    """All files under ``root``, and their names from there on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(root)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    begin = whole.split(":", 1)[-1].lstrip("/") if ":" in whole else whole.lstrip("/")
    return found, F.substring(inside, F.lit(len(begin) + 3), F.char_length(inside))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """name (from ``root`` on) and length of all files under ``root`` but empty ones; contents are not read."""
    found, name = _files(spark, root)
    return found.select(name.alias("name"), "length")


def embed_files(rows: DataFrame, name: str, root: str, into: str, most_bytes: int = 1 << 30) -> DataFrame:
    """``rows`` with ``into``, a struct of bytes and path: the contents of the file under ``root`` that each row names.

    A file that is not there, is empty (Spark lists none), or has more than ``most_bytes``, fails its row; rows that name none get null.
    Only distinct names meet files, so that a file that many rows name is read once.
    """
    found, inside = _files(rows.sparkSession, root)
    files = found.filter(F.col("length") <= most_bytes).select(inside.alias("__name"), F.struct(F.col("content").alias("bytes"), F.col("path")).alias("__file"))
    wanted = rows.select(F.col(name).alias("__name")).filter("__name IS NOT NULL").distinct()
    met = rows.join(wanted.join(files, "__name", "left"), F.col(name) == F.col("__name"), "left")
    lost = F.raise_error(F.concat(F.lit("no such file, or one empty or too large: "), F.col(name))).cast("struct<bytes:binary,path:string>")
    told = F.when(F.col(name).isNull(), F.lit(None)).when(F.col("__file").isNull(), lost).otherwise(F.col("__file"))
    return met.withColumn(into, told).select(*[F.col(f"`{c}`") for c in rows.columns], into)


def write_packed(frames: DataFrame, root: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Frames in files of many episodes, each a range of them in order, so their number follows the bytes and not the episodes.

    An episode of more frames than a file should hold goes on in the next.
    """
    parts = files or int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = frames.repartitionByRange(parts, "episode_index", "frame_index").sortWithinPartitions("episode_index", "frame_index")
    ranged.write.mode(mode).parquet(f"{root}/packed")


def read_packed(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored frames of a range of episodes; row groups of others are passed over by their statistics."""
    frames = spark.read.parquet(f"{root}/packed")
    frames = frames if first is None else frames.filter(F.col("episode_index") >= first)
    return frames if last is None else frames.filter(F.col("episode_index") <= last)


def unstored_episodes(spark: SparkSession, root: str, frames: DataFrame) -> DataFrame:
    """Episodes of ``frames`` of which no file that ``write_packed`` left under ``root`` holds a frame; only their numbers are read."""
    stored = read_packed(spark, root).select("episode_index").distinct()
    return frames.select("episode_index").distinct().join(stored, "episode_index", "left_anti")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """group, key, name, at, value (float32) of a normaliser statistics document."""
    kind = "map<string,map<string,array<float>>>"
    doc = read_document(spark, path, f"state {kind}, action {kind}")
    groups = F.explode(F.map_from_arrays(F.array(F.lit("state"), F.lit("action")), F.array("state", "action"))).alias("group", "keys")
    by_key = doc.select(groups).select("group", F.explode("keys").alias("key", "stats"))
    return by_key.select("group", "key", F.explode("stats").alias("name", "values")).select(
        "group", "key", "name", F.posexplode("values").alias("at", "value")
    )


def write_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def task_matrix(spark: SparkSession, suites: dict[str, int]) -> DataFrame:
    """task_suite, task_id: a row for each task of each suite."""
    return tasks_of(spark.createDataFrame(list(suites.items()), "task_suite string, n int"))


def tasks_of(sizes: DataFrame) -> DataFrame:
    """task_suite, task_id of suites with ``n`` tasks each."""
    return sizes.filter("n > 0").select("task_suite", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("task_id"))


def info_document(frames: DataFrame, fps: float, chunk: int = 1000) -> DataFrame:
    """Counts of a dataset, as its info document has them."""
    return frames.agg(
        F.countDistinct("episode_index").alias("total_episodes"),
        F.count("*").alias("total_frames"),
        F.countDistinct("task_index").alias("total_tasks"),
        F.countDistinct(F.floor(F.col("episode_index") / chunk)).alias("total_chunks"),
    ).withColumns({"chunks_size": F.lit(chunk), "fps": F.lit(fps), "split_train": F.concat(F.lit("0:"), F.col("total_episodes"))})


STATS = "struct<min:array<double>,max:array<double>,mean:array<double>,std:array<double>,count:array<long>>"


def read_episode_stats(spark: SparkSession, root: str) -> DataFrame:
    """episode_index, feature, min, max, mean, std, count: a row per episode and feature."""
    rows = read_jsonl(spark, f"{root}/meta/episodes_stats.jsonl", f"episode_index long, stats map<string,{STATS}>")
    return rows.select("episode_index", F.explode("stats").alias("feature", "s")).select("episode_index", "feature", "s.*")


def legacy_stats(stats: DataFrame, episodes: DataFrame) -> DataFrame:
    """Statistics of a whole dataset, given to each of its episodes; one row a feature, so it is the side that is broadcast."""
    return episodes.select("episode_index").distinct().crossJoin(F.broadcast(stats))


def ingest(rows: DataFrame, tasks: DataFrame, fps: float, episode: str, order: str, task: str) -> DataFrame:
    """Raw rows as frames: frame_index, timestamp (float seconds), index over all episodes, task_index by the task's text."""
    from framewright.operators import episodes, lookups

    numbered = episodes.number_frames(rows, episode, order).withColumn("timestamp", (F.col("frame_index") / fps).cast("float"))
    begin = episodes.offsets(rows, episode).select(F.col(episode).alias("__e"), "begin")
    placed = numbered.join(begin, F.col(episode) == F.col("__e")).withColumn("index", F.col("begin") + F.col("frame_index"))
    met = lookups.lookup(placed.drop("__e", "begin"), tasks, task, "task_index", "task")
    return met.withColumnRenamed(episode, "episode_index").drop(task)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists, in any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return path
    raise FileNotFoundError(f"none of {candidates} exists")


def incomplete_episodes(spark: SparkSession, root: str, frames: DataFrame) -> DataFrame:
    """Episodes of ``frames`` without a data file under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/data")
    number = F.regexp_extract("path", r"episode_index=(\d+)", 1).cast("long")
    return frames.select("episode_index").distinct().join(files.select(number.alias("episode_index")).distinct(), "episode_index", "left_anti")
