"""Simple-8b word-aligned coding of token ids, and files of blocks in it.

A 64-bit word holds a selector in its top 4 bits and ids of one width in the
other 60.  Ids of 2**60 and more are escaped: a word with selector 0, then the
id as it is.  Every document begins at a word of its own, so a block lists for
its documents the number of ids and of words, from which any document, or all
of them at once, can be decoded by whole-array operations.

File format: a Parquet table with one row per block: part, block, ids_before
(ids of the part's earlier blocks), doc_ids, id_counts, word_counts and
payload (little-endian words).  A part holds one range of doc_ids; blocks of a
part, and documents of a block, ascend by doc_id.

Scale.  Texts are encoded where they are read; coded words (about 2 bytes an
id) are dealt by range of doc_id, with bounds from quantiles, and each task
streams its part into blocks of about ``block_ids`` ids.  Reading is one task a
split; only the totals per part are summed in order, one row a part.

Edge cases.  Null text counts as empty (its end id alone).  Rows that repeat a
doc_id follow each other; null doc_ids come first.  An empty table gives an
empty file set and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.memory import frugal
from framewright.llm.text import text_of
from framewright.llm.units import encoder

#: Ids in a word and bits of each, by selector from 1.
LAYOUT = [
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
    (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
ESCAPE = 0
_SELECTOR = np.array([ESCAPE, *range(len(LAYOUT), 0, -1)], "u1")
_MANY = np.array([1, *(many for many, _ in reversed(LAYOUT))], "u1")
BLOCK_IDS = 1 << 16
CODED_BYTES = 4 << 20
#: Ids that are coded at once: few enough for a core's cache.
SLICE_IDS = 1 << 17
KEPT_UNITS = 650_000

_CODED = "part int, doc_id long, n_ids long, words binary"
_BLOCKS = (
    "part int, block int, ids_before long, doc_ids array<long>, id_counts array<long>, word_counts array<long>, payload binary"
)
_READ = "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long"


def all_of_next(good: np.ndarray, n: int) -> np.ndarray | None:
    """Whether each place and the next n - 1 are good, by doubling; None if that is so nowhere."""
    done = 1
    while done < n and good.any():
        step = min(done, n - done)
        good = good[:-step] & good[step:]
        done += step
    return good if good.any() else None


_SMALL = np.array([k.bit_length() for k in range(1 << 16)], "u1")


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if ids.max() < len(_SMALL):
        return _SMALL[ids]
    high = (ids.astype("u8") >> np.uint64(32)).astype("f8"), (ids & np.uint64(0xFFFFFFFF)).astype("f8")
    upper, lower = (np.frexp(x)[1].astype("u1") for x in high)
    return np.where(upper > 0, upper + 32, lower).astype("u1")


def encode(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents, and how many each has.  ``ends``: ends of the documents within ``ids``, ascending."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(len(ends), "i8")
    width = widths(ids)
    left = np.minimum(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n), 255).astype("u1")
    rank = np.zeros(n, "u1")  # of the layout that holds most ids: selectors from the last one on, 0 for an escape
    for s in range(len(LAYOUT), 0, -1):
        many, bits = LAYOUT[s - 1]
        fits = all_of_next(width <= bits, many)
        if fits is None:
            continue
        fits &= left[: len(fits)] >= many
        np.maximum(rank[: len(fits)], fits.view("u1") * np.uint8(len(LAYOUT) + 1 - s), out=rank[: len(fits)])
    step = _MANY[rank].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    start = np.array(starts)
    chosen = _SELECTOR[rank[start]]
    slots = 1 + (chosen == ESCAPE)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), "<u8")
    for s in np.unique(chosen):
        mine = chosen == s
        if s == ESCAPE:
            words[place[mine] + 1] = ids[start[mine]]
            continue
        many, bits = LAYOUT[s - 1]
        at = start[mine]
        packed = np.full(len(at), int(s) << 60, "u8")
        for k in range(many):
            packed |= ids[at + k].astype("u8") << np.uint64(bits * k)
        words[place[mine]] = packed
    doc = np.searchsorted(ends, start, side="right")
    return words, np.bincount(doc, weights=slots, minlength=len(ends)).astype("i8")


def encoded_slices(ids: np.ndarray, ends: np.ndarray, most: int = SLICE_IDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``encode`` of runs of whole documents of about ``most`` ids."""
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    for a, b in pairwise(cuts):
        if a < b:
            begin = int(ends[a - 1]) if a else 0
            yield encode(ids[begin : ends[b - 1]], ends[a:b] - begin)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids that ``words`` hold, in order."""
    words = words.astype("u8")
    selector = (words >> np.uint64(60)).astype("i8")
    literal = np.zeros(len(words), bool)
    i = -1
    for k in np.flatnonzero(selector == ESCAPE).tolist():  # a literal may look like an escape itself
        if k > i:
            i = k + 1
            literal[i] = True
    many = np.array([0, *(m for m, _ in LAYOUT), 0])[selector]
    many[literal] = 1
    place = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), "u8")
    out[place[literal]] = words[literal]
    for s in np.unique(selector[~literal]):
        if s == ESCAPE:
            continue
        mine = np.flatnonzero((selector == s) & ~literal)
        n, bits = LAYOUT[s - 1]
        at, held = place[mine], words[mine]
        for k in range(n):
            out[at + k] = held >> np.uint64(bits * k) & np.uint64((1 << bits) - 1)
    return out


def coded_documents(docs: DataFrame, tokenizer_path: str, bounds: list[int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, doc_id, n_ids and words of every document; the part counts the bounds at or below the doc_id."""

    @frugal
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path, KEPT_UNITS)
        edges = np.array(bounds, "i8")
        for batch in batches:
            docs_of, part = batch.column(0), np.searchsorted(
                edges, batch.column(0).fill_null(np.iinfo("i8").min).to_numpy(), side="right"
            )
            words, counts = [], []
            for ids, ends in ids_of.batches(batch.column(1), CODED_BYTES):
                for run, many in encoded_slices(ids, ends):
                    raw, at = run.tobytes(), np.concatenate([[0], np.cumsum(many * 8)]).tolist()
                    words += [raw[a:b] for a, b in zip(at, at[1:])]
                counts += np.diff(ends, prepend=0).tolist()
            columns = [pa.array(part, pa.int32()), docs_of, pa.array(counts, pa.int64()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_ids", "words"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(code, _CODED)


def part_bounds(docs: DataFrame, parts: int, doc_id: str = "doc_id") -> list[int]:
    """At most ``parts - 1`` doc_ids that deal the rows evenly."""
    if parts < 2:
        return []
    found = docs.select(F.col(doc_id).cast("long").alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 0.1 / parts)
    return sorted({int(x) for x in found})


def write_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    parts: int | None = None,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write all documents' ids, each with the end id 0, in ascending order of doc_id."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = part_bounds(docs, parts, doc_id)

    @frugal
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held, rows = None, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            doc_ids, counts, words = zip(*rows, strict=True)
            values = [part, block, before, doc_ids, counts, [len(w) // 8 for w in words], b"".join(words)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["part", "block", "ids_before", "doc_ids", "id_counts", "word_counts", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for p, doc, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (p != part or held >= block_ids):
                    yield flush()
                    block, before, held, rows = block + 1, before + held, 0, []
                if p != part:
                    part, block, before = p, 0, 0
                rows.append((doc, n, words))
                held += n
        if rows:
            yield flush()

    (
        coded_documents(docs, tokenizer_path, bounds, text, doc_id)
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "words")
        .mapInArrow(blocks, _BLOCKS)
        .write.parquet(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``."""

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, before, docs, counts, _, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = memoryview(decode(np.frombuffer(payload, "<u8")).astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(before + starts),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", F.aggregate("id_counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # one row a part
    return (
        blocks.mapInArrow(read, _READ)
        .join(F.broadcast(offsets), "part")
        .select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document: the scan is pruned to its block, and only its words are decoded."""
    block = spark.read.parquet(path).filter(F.array_contains("doc_ids", doc_id)).first()
    if block is None:
        raise KeyError(doc_id)
    k = block.doc_ids.index(doc_id)
    first = sum(block.word_counts[:k])
    words = np.frombuffer(block.payload, "<u8")[first : first + block.word_counts[k]]
    return decode(words).tolist()
