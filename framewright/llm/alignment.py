"""Tokens of two tokenizers aligned over the bytes of a text.

Every byte of a text has an owner in A, the token that covers it, and one in B.  ``np.repeat`` of token numbers by token
lengths lays both out; two bytes in a row with another pair of owners begin another overlap of an A with a B token, and where
both owners change at once both tokens end, which cuts the text into groups.

Both tokenizers end a token before a space that follows a character other than white space (the byte-level pattern always,
the piece model because no piece of it holds a space after something else, which is checked), so a text falls into units that
are aligned independently and repeat.  New units of a batch are laid out as one array of owners; a worker remembers a bounded
number of them, and a text's figures are sums over its units.

Counts over the corpus.  Each row is written with its distinct pairs of ids and how often it links them.  Pairs are
summed in map tasks first, the highest count of each B id is one row an id (bounded by the vocabulary, so broadcast), and
pairs meet their counts in a join whose hot keys are broadcast and whose results are summed by row before they are shuffled.

Edge cases.  A null or empty text has no tokens, and so has one whose bytes either tokenizer does not give back (a text with
U+2581, which the piece model writes for a space).  Special strings in a text are plain text.  Rows that repeat a doc_id
get a row each, and count each.  A very long text is aligned whole; its units and not its length are in one array of
owners.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.memory import frugal
from framewright.llm.skew import join_keyed
from framewright.llm.text import text_of
from framewright.llm.units import byte_letters
from framewright.storage import materialize

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT_UNITS = 150_000
LONGEST_KEPT = 64
RUN_BYTES = 2 << 20
HASHED_AT_ONCE = 10_000
SPACE = "▁"

_cut = re.compile(r"(?<=\S) ")
_STORED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

#: n_a, n_b, n_groups, pairs of its links (A id * size of B + B id, as 64-bit integers), groups as text.
Unit = tuple[int, int, int, bytes, bytes]


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte, the number of the token that holds it."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where an overlap begins, and those of them where a group does; ``a`` and ``b`` are owners of the same bytes."""
    first = np.ones(min(len(a), 1), bool)
    a_new, b_new = np.concatenate([first, a[1:] != a[:-1]]), np.concatenate([first, b[1:] != b[:-1]])
    return np.flatnonzero(a_new | b_new), np.flatnonzero(a_new & b_new)


class Aligner:
    """Units of text, as after a space, to their alignment; None for a unit whose bytes are not given back."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT_UNITS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: b for b, c in byte_letters().items()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            known = all(c in letters for c in piece)
            self.a_bytes[i] = bytes(letters[c] for c in piece) if known else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)  # then a piece may span two units
        self.a_length, self.b_length = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.size_b, self.kept = len(pieces), kept
        self.known: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}

    def units(self, text: str) -> list[str]:
        """The units of a text, each without the space it begins with; the text's first has the one put before it."""
        spaced = " " + text
        if self.whole:
            return [text]
        head, *rest = _cut.split(spaced)
        return [head[1:], *rest]

    def aligned(self, units: list[str]) -> list[Unit | None]:
        """The alignment of each unit; what is not known is worked out at once."""
        known, older = self.known, self.older
        fresh = [u for u in dict.fromkeys(units) if u not in known and u not in older]
        made = dict(zip(fresh, self._align(fresh), strict=True)) if fresh else {}
        out = [known[u] if u in known else made[u] if u in made else older[u] for u in units]
        for u, unit in zip(units, out):
            if u not in known and len(u) <= LONGEST_KEPT:
                if len(known) >= self.kept:
                    self.older, self.known = known, {}
                    known = self.known
                known[u] = unit
        return out

    def _align(self, units: list[str]) -> list[Unit | None]:
        spaced = [" " + u for u in units]
        ids_a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        lone = [self.b.piece_to_id(SPACE)]
        ids_b = [ids if u else lone for u, ids in zip(units, self.b.encode(units, num_threads=1))]  # the model puts a space before, but not before nothing
        out: list[Unit | None] = [None] * len(units)
        fine = []
        for k, text in enumerate(spaced):
            raw = text.encode()
            if b"".join([self.a_bytes[i] for i in ids_a[k]]) == raw == b"".join([self.b_bytes[i] for i in ids_b[k]]):
                fine.append(k)
        if not fine:
            return out
        many_a, many_b = (np.array([len(x[k]) for k in fine]) for x in (ids_a, ids_b))
        a, b = (np.array(list(itertools.chain.from_iterable(x[k] for k in fine))) for x in (ids_a, ids_b))
        own_a, own_b = owners(self.a_length[a]), owners(self.b_length[b])
        starts, groups = overlaps(own_a, own_b)
        pairs = (a[own_a[starts]] * self.size_b + b[own_b[starts]]).astype("<i8")
        begin_a, begin_b = own_a[groups], own_b[groups]  # every unit begins a group
        to_a, to_b = np.cumsum(many_a), np.cumsum(many_b)
        group_to = np.searchsorted(begin_a, to_a)
        link_to = np.searchsorted(own_a[starts], to_a)
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ends_a, ends_b = [*begin_a[1:].tolist(), len(a)], [*begin_b[1:].tolist(), len(b)]
        shown = [
            f"{','.join(text_a[i:j])}|{','.join(text_b[x:y])}"
            for i, j, x, y in zip(begin_a.tolist(), ends_a, begin_b.tolist(), ends_b, strict=True)
        ]
        group_at, link_at = 0, 0
        for n, k in enumerate(fine):
            g, to = int(group_to[n]), int(link_to[n])
            told = ";".join(shown[group_at:g]).encode()
            out[k] = int(many_a[n]), int(many_b[n]), g - group_at, pairs[link_at:to].tobytes(), told
            group_at, link_at = g, to
        return out


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str, kept: int = KEPT_UNITS) -> Aligner:
    """The worker's aligner of these files."""
    return Aligner(a_path, b_path, kept)


def digest(groups: list[bytes]) -> str:
    """SHA-256 of the groups of all units, in pieces."""
    out = hashlib.sha256()
    for k in range(0, len(groups), HASHED_AT_ONCE):
        out.update((b";" if k else b"") + b";".join(groups[k : k + HASHED_AT_ONCE]))
    return out.hexdigest()


def _rows(align: Aligner, texts: list[str]) -> list[list | np.ndarray]:
    """n_a, n_b, n_groups, n_links, digest, ends of the distinct pairs, pairs, times of each text."""
    cut = [align.units(t) if t else [] for t in texts]
    coded = pa.array(list(itertools.chain.from_iterable(cut)), pa.string()).dictionary_encode()
    made = align.aligned(coded.dictionary.to_pylist())
    code, ends = coded.indices.to_numpy(), np.cumsum([0, *map(len, cut)])
    lost = np.array([m is None for m in made], bool)
    figures = np.array([m[:3] if m else (0, 0, 0) for m in made], "i8").reshape(-1, 3)
    links = np.array([len(m[3]) // 8 if m else 0 for m in made], "i8")
    groups = [m[4] if m else b"" for m in made]
    told, kept = [], np.zeros(len(texts), bool)
    for k, (i, j) in enumerate(itertools.pairwise(ends.tolist())):
        kept[k] = j > i and not lost[code[i:j]].any()
        told.append(digest([groups[c] for c in code[i:j].tolist()]) if kept[k] else "")
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    code, of = code[kept[of]], of[kept[of]]
    sums = [np.bincount(of, weights=x[code], minlength=len(texts)).astype("i8") for x in (*figures.T, links)]
    # Pairs of a text: those of its units, one after another, then sorted within the text.
    many = links[code]
    upto = np.cumsum(many)
    total = int(upto[-1]) if len(upto) else 0
    table = np.frombuffer(b"".join(m[3] if m else b"" for m in made), "<i8")
    pairs = table[np.repeat((np.cumsum(links) - links)[code] - (upto - many), many) + np.arange(total)]
    owner = np.repeat(of, many)
    order = np.lexsort((pairs, owner))
    pairs, owner = pairs[order], owner[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(total, 1), bool), (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]))
    times = np.diff(np.append(new, total)).astype("i4")
    return [*sums, told, np.searchsorted(owner[new], np.arange(len(texts) + 1)), pairs[new], times]


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", kept: int = KEPT_UNITS) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs of each row with how often it links them."""

    @frugal
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(a_path, b_path, kept)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype("i8"))
            cuts = [0, *(np.flatnonzero(np.diff(size // RUN_BYTES)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for i, j in itertools.pairwise(cuts):
                if j > i:
                    part = batch.slice(i, j - i)
                    *sums, told, ends, pairs, times = _rows(worker, part.column(2).to_pylist())
                    ends = pa.array(ends, pa.int32())
                    columns = [
                        *part.columns[:2],
                        *map(pa.array, sums),
                        pa.array(told, pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _STORED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(align, _STORED)


def _pairs(rows: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))).alias("x")
    return rows.select("rid", each).select("rid", "x.pair", "x.times")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, links (how many hold it in the corpus), best (no pair of its B id has more), n (rows with it)."""
    counts = _pairs(rows).groupBy("pair").agg(F.sum("times").alias("links"), F.count("*").alias("n"))
    counts = materialize(counts.withColumn("b", F.col("pair") % size_b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))  # a row for each id of B at most
    met = counts.join(F.broadcast(most), "b")
    return materialize(met.select("pair", "links", (F.col("links") == F.col("most")).alias("best"), "n"), "best-pairs")


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    import sentencepiece

    rows = materialize(aligned_rows(docs, a_path, b_path, text, doc_id), "aligned-rows")
    counts = pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    met = join_keyed(_pairs(rows), counts, "pair")
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    told = rows.drop("pairs", "times").join(sums, "rid", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
    return told.withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def id_links(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """a_id, b_id, links, best: how often the corpus links two ids; a mapping between the vocabularies."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = pair_counts(materialize(aligned_rows(docs, a_path, b_path, text, doc_id), "aligned-rows"), size_b)
    return counts.select(F.floor(F.col("pair") / size_b).alias("a_id"), (F.col("pair") % size_b).alias("b_id"), "links", "best")
