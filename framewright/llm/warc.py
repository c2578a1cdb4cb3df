"""WARC archives as a Spark data source, and pages written as responses and revisits.

``warc`` is a Python data source.  Reading plans partitions of whole files, of about ``partition_bytes`` each, and takes
predicates on headers from Spark: a record's headers are parsed first, and a record that fails them is passed over without
its block being decoded (in plain files the file seeks past it; in compressed ones its bytes are inflated and dropped).
The schema that is asked for decides what is worked out: without ``payload`` and ``payload_digest`` no payload is read.

    read_warc(spark, path, "record_id string, target_uri string, record_type string", where="record_type = 'revisit'")

Spark keeps the last predicates that a loaded relation was given, also for queries that give others, so ``where`` is all that
reaches the source; filters that are put on the result stay above it.

Columns that a schema may name: record_type, record_id, target_uri, record_date, refers_to, content_type, stated_digest
(the header's), content_length (of the block), headers (map, names in lower case), payload_bytes, payload_digest (bare
SHA-256, of the bytes read; of records without a payload, the stated one) and payload (binary).

Records are HTTP responses: a block holds HTTP headers, then the payload.  A revisit has the HTTP headers of its page, with
the payload's length, and no payload.  Files are ``.warc.gz``, a gzip member a record, or ``.warc``.

Scale and lost executors.  A task streams its rows into files of about ``file_bytes``, under names that no reader takes
up; the driver gives them their names when all tasks have ended, so a task that is run again leaves nothing twice.  One
record at a time is in memory.  Equal payloads are found by digest, summed in map tasks; digests of one page are dropped and
the rest is joined with hot digests broadcast (see ``skew``), so no group of copies meets in one task.  Files are reached by
pyarrow's file systems: local and mounted folders, HDFS, S3 and Google's store.

Edge cases.  Null html counts as empty.  Null urls give records without a target.  Characters that would break a header
line are percent-encoded.  Rows that repeat a page_id get a record each; if they hold the smallest page_id of equal
payloads, each is a response.  A null page_id is never the smallest, unless all of its group are null.  An empty table gives
archives without records, and no rows.  Extra columns are ignored.  A file that ends inside a record fails with its name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framewright.llm.memory import release
from framewright.llm.skew import join_keyed
from framewright.storage import materialize

LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
LONGEST_HEADER = 1 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PAGE_URI = "urn:page:"

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST = "sha256:"
END = b"\r\n\r\n"

HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "stated_digest": "warc-payload-digest",
    "content_length": "content-length",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, record_date string, refers_to string, content_type string, "
    "stated_digest string, content_length long, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
)
WRITTEN = "record_type string, record_id string, target_uri string, record_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"

COLUMNS, WRITTEN_COLUMNS = ([f.split()[0] for f in ddl.split(", ")] for ddl in (SCHEMA, WRITTEN))

_unsafe = re.compile(r"[\x00-\x20\x7f<>]").sub


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system of a path or URI as Spark writes them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path) if ":" in path else f"file://{path}")


# ---- one record -------------------------------------------------------------------------------------------------------


def record_bytes(
    record_type: str, record_id: str, target_uri: str | None, date: str, refers_to: str | None, digest: str, length: int, payload: bytes | None
) -> bytes:
    """A record with its HTTP headers; ``length`` is of the full payload, which a revisit does not carry."""
    revisit = record_type == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + END
    block = http if revisit else http + (payload or b"")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if target_uri is not None:
        fields.append(("WARC-Target-URI", _unsafe(lambda m: f"%{ord(m[0]):02X}", target_uri)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", DIGEST + digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode()
    return head + END + block + END


def header_lines(stream: io.BufferedIOBase, left: int = LONGEST_HEADER) -> list[str] | None:
    """Lines up to an empty one; None at the stream's end."""
    lines = []
    while line := stream.readline(left):
        left -= len(line)
        if not line.endswith(b"\n"):
            raise ValueError("a header is cut off or too long")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            if lines:
                return lines
            continue  # between records
        if text[0] in " \t" and lines:
            lines[-1] += " " + text.strip()
        else:
            lines.append(text)
    if lines:
        raise ValueError("a header is cut off")
    return None


def named(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class Counted(io.RawIOBase):
    """At most ``left`` bytes of a stream, and how many of them have been taken."""

    def __init__(self, stream: io.BufferedIOBase, left: int):
        self.stream, self.left = stream, left

    def readline(self, most: int = -1) -> bytes:
        line = self.stream.readline(min(self.left, most) if most >= 0 else self.left)
        self.left -= len(line)
        return line

    def chunks(self) -> Iterator[bytes]:
        while self.left:
            got = self.stream.read(min(self.left, CHUNK))
            if not got:
                raise ValueError("a block is cut off")
            self.left -= len(got)
            yield got

    def skip(self, seekable: bool) -> None:
        """Pass over what is left."""
        if seekable and self.left:
            self.stream.seek(self.left - 1, io.SEEK_CUR)
            self.left = 1
        for _ in self.chunks():
            pass


def bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def of_headers(headers: dict[str, str], column: str) -> str | int | None:
    """The value of a header column."""
    value = headers.get(HEADER_OF[column])
    if column == "content_length":
        return int(value)
    if column == "stated_digest" and value is not None:
        return value.removeprefix(DIGEST)
    return bare(value)


def records(
    stream: io.BufferedIOBase, seekable: bool, columns: list[str], tests: list[Callable[[dict], bool]], seen: dict[str, int] | None = None
) -> Iterator[dict]:
    """The records that pass all tests on their headers, with the columns asked for.

    ``seen`` counts records, and bytes of payload that were read.
    """
    seen = {} if seen is None else seen
    want_payload = "payload" in columns
    want_bytes = want_payload or "payload_digest" in columns
    while (lines := header_lines(stream)) is not None:
        headers = named(lines[1:])
        if not lines[0].startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise ValueError(f"no record begins with {lines[0]!r}")
        seen["records"] = seen.get("records", 0) + 1
        block = Counted(stream, int(headers["content-length"]))
        if all(test(headers) for test in tests):
            row = {c: of_headers(headers, c) for c in columns if c in HEADER_OF}
            row["headers"] = headers
            http = {}
            if headers.get("content-type", "").startswith("application/http"):
                http = named((header_lines(block) or [""])[1:])
            if headers.get("warc-type") == "revisit":
                row["payload_bytes"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                row["payload_digest"] = of_headers(headers, "stated_digest")
            else:
                row["payload_bytes"] = block.left
                if want_bytes:
                    seen["payload_bytes"] = seen.get("payload_bytes", 0) + block.left
                    digest, kept = hashlib.sha256(), []
                    for part in block.chunks():
                        digest.update(part)
                        if want_payload:
                            kept.append(part)
                    row |= {"payload_digest": digest.hexdigest(), "payload": b"".join(kept)}
            block.skip(seekable)
            yield {c: row.get(c) for c in columns}
        else:
            block.skip(seekable)


# ---- predicates -------------------------------------------------------------------------------------------------------

_COMPARE: dict[type, Callable] = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    IsNull: lambda x, _: x is None,
    IsNotNull: lambda x, _: x is not None,
}
_ORDERED = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


@dataclass
class HeaderTest:
    """A predicate on one header column."""

    kind: type
    column: str
    value: object

    def __call__(self, headers: dict[str, str]) -> bool:
        return _COMPARE[self.kind](of_headers(headers, self.column), self.value)


def header_test(wanted: Filter) -> HeaderTest | None:
    """The test that ``wanted`` makes of the headers; None if it can't be told from them.

    Strings are ordered by code point in Python and by UTF-8 bytes in Spark, which is the same order.
    """
    kind, path = type(wanted), getattr(wanted, "attribute", ())
    if kind not in _COMPARE or len(path) != 1 or path[0] not in HEADER_OF:
        return None
    value = getattr(wanted, "value", None)
    if kind in _ORDERED and value is None:
        return None
    return HeaderTest(kind, path[0], value)


# ---- the data source --------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


def planned(sizes: list[tuple[str, int]], most: int) -> list[Files]:
    """Files put together up to about ``most`` bytes; a larger file stands alone."""
    out, held, total = [], [], 0
    for path, size in sorted(sizes):
        if held and total + size > most:
            out.append(Files(tuple(held)))
            held, total = [], 0
        held.append(path)
        total += size
    return [*out, Files(tuple(held))] if held else out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes
        self.schema, self.tests = schema, []
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            test = header_test(wanted)
            if test is None:
                yield wanted
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = file_system(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            found = [store.get_file_info(root)]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
        kept = [f for f in found if f.is_file and f.base_name[0] not in "_." and f.base_name.endswith((".warc", ".warc.gz"))]
        return planned([(f.path, f.size) for f in kept], self.partition_bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, columns = to_arrow_schema(self.schema), self.schema.names
        store, _ = file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            try:
                zipped = path.endswith(".gz")
                with store.open_input_file(path) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, CHUNK)
                    for row in records(stream, not zipped, columns, self.tests):
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield batch_of(rows, schema)
                            rows, held = [], 0
            except (ValueError, EOFError, OSError, zlib.error) as e:
                raise ValueError(f"{path}: {e}") from e
        if rows:
            yield batch_of(rows, schema)
        release()


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def column(f: pa.Field) -> pa.Array:
        values = [r[f.name] for r in rows]
        return pa.array([list(v.items()) for v in values] if f.name == "headers" else values, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: the name while it is written, and the name it gets."""

    names: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, file_bytes: int, zipped: bool):
        self.path, self.file_bytes, self.zipped = path, file_bytes, zipped
        lacks = set(WRITTEN_COLUMNS) - set(schema.names)
        if lacks:
            raise ValueError(f"columns are missing: {sorted(lacks)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                payload = batch.column("payload")
                cells = zip(*(batch.column(c).to_pylist() for c in WRITTEN_COLUMNS[:-1]), strict=True)
                for k, (kind, record_id, uri, date, refers_to, digest, length) in enumerate(cells):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        token = uuid.uuid4().hex
                        names.append((f"{root}/_pending-{token}", f"{root}/part-{token}.warc" + ".gz" * self.zipped))
                        out, size = store.open_output_stream(names[-1][0], compression=None), 0
                    block = payload[k].as_buffer()
                    record = record_bytes(kind, record_id, uri, date, refers_to, digest, length, block.to_pybytes() if block is not None else None)
                    if self.zipped:
                        record = gzip.compress(record, LEVEL, mtime=0)
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        release()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for pending, final in message.names if message else ():
                store.move(pending, final)

    def abort(self, messages: list[Written]) -> None:
        store, _ = file_system(self.path)
        for message in messages:
            for pending, _ in message.names if message else ():
                store.delete_file(pending)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, not replaced")
        zipped = self.options.get("compression", "gzip") != "none"
        return WarcWriter(self.options["path"], schema, int(self.options.get("file_bytes", FILE_BYTES)), zipped)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark hand it predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, where: str | Column | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The records under ``path`` for which ``where`` holds, with the columns that ``schema`` names.

    The filter that is always true may change from row to row as far as Spark knows, so no other passes it.
    """
    register(spark)
    found = spark.read.format("warc").schema(schema).option("partition_bytes", partition_bytes).load(path)
    return (found if where is None else found.filter(where)).filter(F.monotonically_increasing_id() >= 0)


def write_warc(rows: DataFrame, path: str, zipped: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Add archives of ``rows`` (columns of ``WRITTEN``) to the folder ``path``."""
    register(rows.sparkSession)
    writer = rows.write.format("warc").mode("append").option("compression", "gzip" if zipped else "none")
    writer.option("file_bytes", file_bytes).save(path)


# ---- pages ------------------------------------------------------------------------------------------------------------


def page_records(
    pages: DataFrame, least: int = LEAST_REVISIT, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE
) -> DataFrame:
    """A record per page: of equal payloads of at least ``least`` bytes, the smallest page_id's is a response, others revisit it."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1").select("payload_digest", "first", "n", F.lit(True).alias("shared")), "equal-payloads")
    met = join_keyed(rows, groups, "payload_digest", "left")
    again = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit(PAGE_URI), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        uri("page_id").alias("record_id"),
        "target_uri",
        F.lit(date).alias("record_date"),
        F.when(again, uri("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **kind) -> None:
    write_warc(page_records(pages, **kind), path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives."""
    wanted = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    found = read_warc(spark, path, wanted)
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
