"""Best-fit packing of token sequences with swap-based local search.

Documents become ids with an end id; those longer than a sequence are cut into
pieces of full length, the first piece taking the rest.  Pieces of full length
are sequences of their own.  The others are dealt evenly over groups of about
``group_pieces`` pieces by a hash of their row; each group is packed by best
fit, longest first, and then improved: between bins that are not full, pieces
are moved or exchanged one for one or two for one whenever that raises the sum
of squared fills, which drives the emptiest bins to nothing.

Scale.  Texts never leave the task that reads them: only (doc_id, length, crc)
rows are shuffled.  A group is bounded, so memory is too, and more rows mean
more groups; each group ends with about one bin that is not full.  The search
ends where no exchange raises the sum, or where fewer bins can't hold the pieces.

Edge cases.  Null text counts as empty; an empty text is the end id alone.
Rows that repeat a doc_id are packed like any others; null doc_ids are kept.
Of pieces of one length, the earlier row comes first.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.memory import frugal, small_batches
from framewright.llm.text import text_of
from framewright.llm.units import KEPT_UNITS, encoder
from framewright.storage import materialize

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 16_384

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of ``n`` ids, and ``n``."""
    if n <= capacity:
        return [0, n]
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = SEQUENCE_TOKENS,
    text: str = "text",
    doc_id: str = "doc_id",
    kept_units: int = KEPT_UNITS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""

    @frugal
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, kept_units)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            docs_of = iter(batch.column(0).to_pylist())
            for run, ends in encode.batches(batch.column(1)):
                ids, begin = memoryview(run.tobytes()), 0
                for end, doc in zip(ends.tolist(), docs_of):
                    at = [begin + x for x in cut(end - begin, capacity)]
                    rows += [
                        (doc, k, a - begin, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(pairwise(at))
                    ]
                    begin = end
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        pieces, _PIECES
    )


class Bins:
    """Bins of one group: fills and the pieces in each, found by their free space."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the bin that it fills best."""
        with_space: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        spaces = 0  # bit s is set if a bin has s free
        for i in sorted(range(len(self.sizes)), key=self.sizes.__getitem__, reverse=True):
            n = self.sizes[i]
            fits = spaces >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                b = with_space[free].pop()
                if not with_space[free]:
                    spaces ^= 1 << free
                self.items[b].append(i)
                self.fill[b] += n
            else:
                b, free = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(n)
            if left := free - n:
                with_space[left].append(b)
                spaces |= 1 << left

    def local_search(self) -> None:
        """Empty bins into fuller ones while that raises the sum of squared fills, until no exchange does.

        The emptiest bin gives: of all moves into a bin that is at least as full, else of all exchanges one for one, else
        of all two for one, the one that raises the sum most is made.  A bin that has none is passed over until others
        have changed.  Each exchange raises a bounded sum, so the search ends; it ends at once when no fewer bins could
        hold the pieces.
        """
        size, fill = np.array(self.sizes, "i8"), np.array(self.fill, "i8")
        where = np.zeros(len(size), "i8")
        for b, items in enumerate(self.items):
            where[items] = b
        least = -(-int(size.sum()) // self.capacity)
        again = True
        while again and np.count_nonzero(fill) > least:
            again, passed = False, np.zeros(len(fill), bool)
            while np.count_nonzero(fill) > least:
                givers = np.flatnonzero((fill > 0) & (fill < self.capacity) & ~passed)
                if not len(givers):
                    break
                a = int(givers[fill[givers].argmin()])
                found = self._best(a, size, fill, where)
                if found is None:
                    passed[a] = True
                    continue
                out, back, b = found
                d = int(size[out].sum() - size[back].sum())
                where[out], where[back] = b, a
                fill[a] -= d
                fill[b] += d
                again = True
        self.fill = fill.tolist()
        self.items = [[] for _ in self.fill]
        for i, b in enumerate(where.tolist()):
            self.items[b].append(i)

    def _best(self, a: int, size: np.ndarray, fill: np.ndarray, where: np.ndarray) -> tuple[list[int], list[int], int] | None:
        """Pieces that bin ``a`` gives, pieces that it takes, and the bin: what raises the sum of squares most."""
        mine = np.flatnonzero(where == a)
        _, first = np.unique(size[mine], return_index=True)  # pieces of one size are alike
        ones = mine[first]
        takers = np.flatnonzero((fill >= fill[a]) & (fill < self.capacity))
        takers = takers[takers != a]
        if not len(takers):
            return None
        free = self.capacity - fill
        moved = np.where(size[ones][:, None] <= free[takers], size[ones][:, None], 0)
        gain = np.where(moved > 0, moved * (fill[takers] - fill[a] + moved), 0)
        k, t = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[k, t] > 0:
            return [int(ones[k])], [], int(takers[t])
        open_to = np.zeros(len(fill), bool)
        open_to[takers] = True
        theirs = np.flatnonzero(open_to[where])
        room, ahead = free[where[theirs]], fill[where[theirs]] - fill[a]

        def swap(give: np.ndarray, of: list[list[int]]) -> tuple[list[int], list[int], int] | None:
            best, choice = 0, None
            for begin in range(0, len(give), 64):
                d = give[begin : begin + 64, None] - size[theirs]
                gain = np.where((d > 0) & (d <= room), d * (ahead + d), 0)
                k, t = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[k, t] > best:
                    best, choice = gain[k, t], (of[begin + k], [int(theirs[t])], int(where[theirs[t]]))
            return choice

        found = swap(size[ones], [[int(i)] for i in ones])
        if found is not None:
            return found
        pairs: dict[int, list[int]] = {}
        for x in range(len(mine)):
            for y in range(x):
                pairs.setdefault(int(size[mine[x]] + size[mine[y]]), [int(mine[x]), int(mine[y])])
        return swap(np.array(list(pairs), "i8"), list(pairs.values())) if pairs else None

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each piece."""
        which, offset = np.zeros(len(self.sizes), "i8"), np.zeros(len(self.sizes), "i8")
        for number, items in enumerate(x for x in self.items if x):
            at = 0
            for i in items:
                which[i], offset[i] = number, at
                at += self.sizes[i]
        return which, offset


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.  ``pieces`` has a column length, from 1 to ``capacity``."""
    with small_batches(pieces.sparkSession):
        rows = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") == capacity)
    short = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    schema = short.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def pack_group(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        bins = Bins(table["length"].to_pylist(), capacity)
        bins.best_fit()
        bins.local_search()
        which, offset = bins.places()
        table = table.drop_columns("__group").append_column("sequence_id", pa.array((key[0].as_py() << 32) + which))
        return table.append_column("offset", pa.array(offset))

    packed = (
        short.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
        .groupBy("__group")
        .applyInArrow(pack_group, schema)
    )
    alone = whole.withColumns({"sequence_id": -1 - F.col("__row"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone).drop("__row")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = SEQUENCE_TOKENS,
    text: str = "text",
    doc_id: str = "doc_id",
    kept_units: int = KEPT_UNITS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(token_pieces(docs, tokenizer_path, capacity, text, doc_id, kept_units), capacity)
