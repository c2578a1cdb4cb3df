"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit set where more than half of its shingles'
hashes have it.  Fingerprints that differ in at most ``radius`` bits link, and
documents are grouped by the components of those links.

The tree.  In a BK-tree the children of a node are keyed by their Hamming
distance to it.  By the triangle inequality, all fingerprints within the radius
of a query that is at distance d from a node hang on its edges d - radius to
d + radius; a search follows no others.

The shards.  The 64 bits are cut into ``BANDS`` bands; two fingerprints within
3 bits agree in at least two of five bands, so each pair of bands with its
values names a shard and every link lies within one (any radius below
``BANDS - 1`` is exact).  A shard's tree goes to the task that gets the
queries of that shard, by a shuffle of 8-byte fingerprints: one broadcast of
all trees would grow with the corpus.  A shard of more than ``TREE_NODES``
fingerprints is dealt into several trees of bounded size, and each meets all
the shard's fingerprints in chunks, so nothing is left out and no task holds
more than a tree and a chunk.

Only links that join two groups of a task are reported (at most one fewer than
the task's fingerprints): enough for the components, and never all pairs.

Edge cases.  Null and empty texts have the fingerprint zero and link like any
others.  Texts of fewer words than a shingle count as one shingle.  Rows that
repeat a doc_id get one row each.  A null doc_id gets a fingerprint and, if it
is alone, a null component.  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.components import components
from framewright.llm.memory import frugal, small_batches
from framewright.llm.skew import join_keyed
from framewright.llm.text import text_of, unused
from framewright.storage import broadcast_within, discard, materialize, scratch

RADIUS = 3
SHINGLE_WORDS = 5
BANDS = 5
TREE_NODES = 4096
SEED = 42
SIMILARITY = 0.8
WIDE_RADIUS = 18
TABLES = 9
GROUP = 3
CHUNK = 1024
ROUNDS = 3
PARITY_BITS = 1024
RANK_BITS = 22
RANK_BLOCK = 1 << 12
BROADCAST_ROWS = 100_000
OUT_HASHES = 1 << 20
HUB_ROWS = 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of all shingles of ``words`` words, repeats included; of all words, if they are fewer; none without words."""
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(tokens[k:] for k in range(words)), strict=False) if n > 1 or len(tokens) == words else [tokens]
    return np.fromiter((digest(b" ".join(s), SEED) for s in shingles), "<u8", n)


def fingerprint(text: str, words: int) -> int:
    """The 64-bit SimHash of all shingles of ``words`` words, repeats included."""
    return simhash_of(shingle_hashes(text, words))


def simhash_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    votes = np.zeros(64, "i8")
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every row."""

    @frugal
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8"))], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(of_batches, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints; built, and searched for many queries at once, level by level."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        key, parent = np.full(n, -1), np.full(n, -1)
        groups = [np.arange(n)] if n else []
        while groups:  # the first of a group is a node; the rest part by their distance to it
            below = []
            for group in groups:
                rest = group[1:]
                if len(rest):
                    distance = np.bitwise_count(points[rest] ^ points[group[0]])
                    order = np.argsort(distance, kind="stable")
                    rest, distance = rest[order], distance[order]
                    cuts = np.flatnonzero(np.diff(distance)) + 1
                    for part, d in zip(np.split(rest, cuts), distance[np.concatenate([[0], cuts])], strict=True):
                        parent[part[0]], key[part[0]] = group[0], d
                        below.append(part)
            groups = below
        self.key = key
        self.order = np.argsort(parent, kind="stable")  # children of a node stand together
        sorted_parents = parent[self.order]
        self.begin = np.searchsorted(sorted_parents, np.arange(n), "left")
        self.end = np.searchsorted(sorted_parents, np.arange(n), "right")

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the query, index of the point) for all points within the radius, a level at a time."""
        who, node = np.arange(len(queries)), np.zeros(len(queries), "i8")
        if not len(self.points):
            return
        while len(who):
            distance = np.bitwise_count(queries[who] ^ self.points[node]).astype("i8")
            near = distance <= radius
            yield who[near], node[near]
            many = self.end[node] - self.begin[node]
            who, distance = np.repeat(who, many), np.repeat(distance, many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            child = self.order[np.repeat(self.begin[node], many) + within]
            follow = np.abs(self.key[child] - distance) <= radius
            who, node = who[follow], child[follow]


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def band_masks(bands: int = BANDS) -> list[int]:
    """The bits of each pair of bands."""
    edges = [64 * k // bands for k in range(bands + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(single, 2)]


def spanning_links(fps: np.ndarray, trees: int, radius: int, chunk: int = 256) -> list[tuple[int, int]]:
    """Links that join up the fingerprints: the first ``trees`` are in the tree, all search it.

    Pairs that other links have joined already are passed over as whole arrays.
    """
    tree = BKTree(fps[:trees])
    groups, out, label = Groups(len(fps)), [], np.arange(len(fps))
    for a in range(0, len(fps), chunk):
        for who, node in tree.search(fps[a : a + chunk], radius):
            who = who + a
            apart = label[who] != label[node]
            before = len(out)
            for x, y in zip(who[apart].tolist(), node[apart].tolist(), strict=True):
                if groups.join(x, y):
                    out.append((x, y))
            if len(out) > before:
                label = np.array([groups.root(x) for x in range(len(fps))])
    return out


def nearest_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join up the fingerprints, the nearest pairs first."""
    found = list(BKTree(fps).search(fps, radius))
    who, node = (np.concatenate([pair[k] for pair in found]) for k in (0, 1))
    who, node = who[who < node], node[who < node]
    groups = Groups(len(fps))
    order = np.argsort(np.bitwise_count(fps[who] ^ fps[node]), kind="stable")
    return [(x, y) for x, y in zip(who[order].tolist(), node[order].tolist(), strict=True) if groups.join(x, y)]


def shard_links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """a, b: enough links between fingerprints within ``radius`` bits to join up their groups.

    ``distinct`` has one column fp without repeats.
    """
    if radius > BANDS - 2:
        raise ValueError(f"two of {BANDS} bands agree only up to {BANDS - 2} bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in band_masks()]
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])
        ).alias("shard"),
    ).select("fp", "shard.band", "shard.bits")
    return linked_cells(keyed, radius, tree_nodes)


def linked_cells(keyed: DataFrame, radius: int, tree_nodes: int) -> DataFrame:
    """a, b: fingerprints that link in the shards (band, bits) of ``keyed``, which has fp."""
    sizes = keyed.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.withColumn("trees", F.ceil(F.col("n") / tree_nodes).cast("int")), "shards")
    # A large shard is met tree by chunk: every fingerprint is in one tree, and queries all trees from its own on.
    spread = join_keyed(keyed, sizes, ["band", "bits"])
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    by_tree = spread.select("fp", "band", "bits", "mine", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    cells = by_tree.select(
        "fp",
        "band",
        "bits",
        F.least("mine", "other").alias("tree"),
        F.greatest("mine", "other").alias("chunk"),
        (F.col("mine") <= F.col("other")).alias("in_tree"),
    )
    at = ["band", "bits", "tree", "chunk"]
    dealt = cells.repartition(*at).sortWithinPartitions(*at, F.col("in_tree").desc(), "fp")
    return dealt.mapInArrow(by_cell(at, lambda rows, starts: cell_links(rows, starts, radius)), "a long, b long")


Links = Callable[[pa.Table, np.ndarray], pa.RecordBatch]


def by_cell(at: list[str], links: Links) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over sorted rows: ``links`` of whole cells.  A cell that a batch breaks off goes on in the next."""

    @frugal
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                held.append(batch)
            if not held or batch is not None and all(held[0].column(c)[0] == batch.column(c)[batch.num_rows - 1] for c in at):
                continue
            rows = pa.Table.from_batches(held)
            starts = cell_starts(rows, at)
            whole = rows.num_rows if batch is None else int(starts[-1])
            yield links(rows.slice(0, whole), starts if batch is None else starts[:-1])
            held = [b for b in rows.slice(whole).to_batches() if b.num_rows]

    return task


def cell_starts(rows: pa.Table, at: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in at:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def cell_links(rows: pa.Table, starts: np.ndarray, radius: int, ends_of: str = "fp") -> pa.RecordBatch:
    """a, b: values of the column ``ends_of`` that link; with ``in_tree``, only such rows are in the trees."""
    points = rows["fp"].to_numpy().view("u8")
    inside = rows["in_tree"].to_numpy() if "in_tree" in rows.column_names else None
    left, right = [], []
    for a, b in zip(starts.tolist(), np.append(starts[1:], rows.num_rows).tolist(), strict=True):
        if b - a == 2:  # a tree of one node and its one query
            found = [(0, 1)] if (int(points[a]) ^ int(points[a + 1])).bit_count() <= radius else []
        elif inside is None:
            found = nearest_links(points[a:b], radius) if b - a > 1 else []
        else:
            found = spanning_links(points[a:b], int(inside[a:b].sum()), radius)
        left += [a + x for x, _ in found]
        right += [a + y for _, y in found]
    values = rows[ends_of].to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(values[np.array(side, "i8")]) for side in (left, right)], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    text: str = "text",
    doc_id: str = "doc_id",
    tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the component's smallest doc_id) of every row."""
    rows = materialize(fingerprints(docs, words, text, doc_id), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = materialize(shard_links(nodes.select("fp"), radius, tree_nodes), "fingerprint-links")
    found = components(links)
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left")
    rooted = materialize(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def parity_sketch(hashes: np.ndarray) -> bytes:
    """For each of the least power of two of bits that is at least twice the set (``PARITY_BITS`` or more), whether an odd number of hashes falls on it."""
    bits = max(PARITY_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else PARITY_BITS
    flips = np.bincount((hashes >> np.uint64(8)).astype("i8") % bits, minlength=bits) % 2
    return np.packbits(flips.astype("u1"), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, once the wider one is folded to the other's width: at most the hashes that one set has alone."""
    x, y = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype="i8"))


def listed(parts: list[np.ndarray]) -> pa.Array:
    """A list array of these parts."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))


def sketches(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """node, doc_id, text_hash, fp, keys, hashes (the set of all shingles' hashes, in order), parity and n_set of every row.

    keys: TABLES hashes, each of GROUP least hashes of the shingles under one mixing; two texts of similarity s have one
    in common with probability 1 - (1 - s**GROUP)**TABLES, which is 0.998 at 0.8.
    """
    mixers = np.random.default_rng(SEED).integers(1, 1 << 63, (TABLES * GROUP, 2), "u8") | np.uint64(1)

    @frugal
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sets, parity, begin, held = [], [], [], [], 0, 0
            for k in range(batch.num_rows):
                own = np.unique(shingle_hashes(batch.column(3)[k].as_py(), words))
                fps.append(simhash_of(own) if len(own) else 0)  # of the set: links are judged on sets
                low = np.array([((own ^ x) * m >> np.uint64(20)).min(initial=1 << 44) for x, m in mixers], "u8")
                keys.append(np.bitwise_xor.reduce(low.reshape(TABLES, GROUP) * mixers[:GROUP, 1], axis=1).view("i8"))
                sets.append(np.sort(own.view("i8")))
                parity.append(parity_sketch(own))
                held += len(own)
                if held > OUT_HASHES or k == batch.num_rows - 1:
                    same = [c.slice(begin, len(sets)) for c in batch.columns[:3]]
                    columns = [pa.array(np.array(fps, "u8").view("i8")), listed(keys), listed(sets), pa.array(parity, pa.binary()), pa.array([len(x) for x in sets], pa.int32())]
                    names = ["node", "doc_id", "text_hash", "fp", "keys", "hashes", "parity", "n_set"]
                    yield pa.RecordBatch.from_arrays([*same, *columns], names)
                    fps, keys, sets, parity, begin, held = [], [], [], [], k + 1, 0

    chosen = docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)), text_of(text)
    )
    schema = "node long, doc_id long, text_hash long, fp long, keys array<long>, hashes array<long>, parity binary, n_set int"
    return chosen.mapInArrow(of_batches, schema)


def alike(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """a, b of the written ``pairs`` of nodes whose whole shingle sets are alike; two empty sets are."""
    few = broadcast_within(pairs, BROADCAST_ROWS)
    left, right = (rows.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")).join(few, c) for c in "ab")
    met = left.select("a", "b", "set_a").join(right.select("a", "b", "set_b"), ["a", "b"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    met = met.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return materialize(met.filter(F.col("shared") >= similarity * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b"), "alike")


def tree_links(nodes: DataFrame, radius: int, chunk: int, salt: int) -> tuple[DataFrame, bool]:
    """a, b: nodes of a shard (band, bits) whose fingerprints a BK-tree finds within the radius, the nearest first.

    A shard of more than ``chunk`` nodes is dealt into trees of about that many, each with its own queries only; whether
    there are any is told, so that the groups of all trees can be met in a further round.
    """
    sizes = nodes.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "shards")
    dealt = join_keyed(nodes, sizes, ["band", "bits"])
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("chunks")).cast("int")).drop("chunks")
    at = ["band", "bits", "tree"]
    dealt = dealt.repartition(*at).sortWithinPartitions(*at, "node")
    found = dealt.mapInArrow(by_cell(at, lambda rows, starts: cell_links(rows, starts, radius, "node")), "a long, b long")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(found, "tree-links"), not sizes.filter("chunks > 1").isEmpty()


def groups_of(links: DataFrame | None) -> DataFrame | None:
    """member, root: the groups that ``links`` make, written; None without links."""
    return None if links is None else materialize(components(links).withColumnRenamed("node", "member"), "groups")


def grouped(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``nodes`` with root: the least node of the group, itself where there is none."""
    if groups is None:
        return nodes.withColumn("root", F.col("node"))
    met = nodes.join(broadcast_within(groups, BROADCAST_ROWS), F.col("node") == F.col("member"), "left")
    return met.withColumn("root", F.coalesce("root", "node")).drop("member")


def shard_groups(rows: DataFrame, radius: int, similarity: float, chunk: int) -> tuple[DataFrame | None, DataFrame | None]:
    """a, b: links that the BK-trees of all shards find and the sets bear out, and their groups; None if there are none.

    Nodes that a round has joined stand for themselves by one of them in the next, so a shard of many near copies shrinks.
    """
    keyed = rows.select("node", "fp", F.posexplode("keys").alias("band", "bits"))
    shared = materialize(keyed.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    keyed = materialize(join_keyed(keyed, shared, ["band", "bits"]), "keyed")
    links = groups = None
    for k in range(ROUNDS):
        nodes = keyed
        if links is not None:
            nodes = grouped(keyed, groups).groupBy("band", "bits", "root").agg(F.min(F.struct("node", "fp")).alias("one"))
            nodes = materialize(nodes.select("one.*", "band", "bits"), "one-a-group")
        found, more = tree_links(nodes, radius, chunk, k)
        found = alike(may_be_alike(found, rows, similarity), rows, similarity)
        if found.isEmpty():  # the groups are still those of all links
            break
        links = found if links is None else links.unionByName(found)
        groups = groups_of(links)
        if not more:
            break
    return links, groups


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How often shingles whose hashes begin with the same RANK_BITS bits occur in the corpus; of fixed size.

    Two tasks a core count whole tables, which are added block by block, so what is shuffled does not grow with the corpus.
    """

    @frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << RANK_BITS, "u4"), [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(0).flatten().to_numpy().view("u8") >> np.uint64(64 - RANK_BITS)).astype("i4"))
                size += len(held[-1])
            if size > OUT_HASHES or batch is None and size:
                counts += np.bincount(np.concatenate(held), minlength=1 << RANK_BITS).astype("u4")
                held, size = [], 0
        seen = np.flatnonzero(counts.reshape(-1, RANK_BLOCK).any(axis=1))
        for part in np.array_split(seen, -(-len(seen) // 64)) if len(seen) else []:
            blocks = [counts[k * RANK_BLOCK : (k + 1) * RANK_BLOCK].tobytes() for k in part.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(blocks, pa.binary())], ["block", "counts"])

    def added(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype("u8") for x in table["counts"])
        total = np.minimum(total, np.iinfo("u4").max).astype("<u4")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    with small_batches(rows.sparkSession):
        few = rows.select("hashes").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
        found = materialize(few.mapInArrow(counted, schema).groupBy("block").applyInArrow(added, schema), "bucket-counts")
    out = np.zeros((1 << RANK_BITS) // RANK_BLOCK * RANK_BLOCK, "u4").reshape(-1, RANK_BLOCK)
    for row in found.toLocalIterator():
        out[row.block] = np.frombuffer(row.counts, "<u4")
    discard(found)
    return out.reshape(-1)


def rarest(rows: DataFrame, similarity: float) -> DataFrame:
    """node, root, n_set, rare of every row with shingles: its rarest hashes, one more than an alike text may lack.

    In one order of all hashes, the first that two alike texts share has at most that many before it in either, so they
    meet in one of these.  Any order is exact; by the corpus counts of buckets, common passages come last.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bucket_counts(rows))

    @frugal
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                hashes = batch.column(3)[k].values.to_numpy()
                lack = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9))
                order = np.lexsort((hashes, counts[(hashes.view("u8") >> np.uint64(64 - RANK_BITS)).astype("i8")]))[: lack + 1]
                out.append(hashes[order])
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], listed(out)], ["node", "root", "n_set", "rare"])

    some = rows.filter("n_set > 0").select("node", "root", "n_set", "hashes")
    with small_batches(rows.sparkSession):
        return materialize(some.mapInArrow(least, "node long, root long, n_set int, rare array<long>"), "rarest")


def may_be_alike(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The written ``pairs`` (a, b and further longs) less those that are apart for sure.

    Two parity sketches differ in at most as many bits as there are shingles that only one of the texts has.
    """
    few = broadcast_within(pairs, BROADCAST_ROWS)
    left, right = (rows.select(F.col("node").alias(c), F.col("parity").alias(f"parity_{c}"), F.col("n_set").alias(f"n_{c}")) for c in "ab")
    both = left.join(few, "a").join(right, "b")
    both = both.select(*pairs.columns, "parity_a", "parity_b", (F.col("n_a") + F.col("n_b")).alias("total"))
    width = len(pairs.columns)

    @frugal
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(width), batch.column(width + 1)
            differ = np.array([parity_distance(x[k].as_py(), y[k].as_py()) for k in range(batch.num_rows)], "i8")
            may = differ <= batch.column(width + 2).to_numpy() * (1 - similarity) / (1 + similarity) + 1e-6
            yield batch.select(list(range(width))).filter(pa.array(may))

    with small_batches(rows.sparkSession):
        return materialize(both.mapInArrow(near, pairs.schema), "near-pairs")


def enough(similarity: float) -> Column:
    """Whether node and node_b, which meet at ``place`` and ``place_b``, may share enough shingles from there on, by their sizes."""
    need = (F.col("n_set") + F.col("n_set_b")) * (similarity / (1 + similarity)) - 1e-6
    sized = F.least("n_set", "n_set_b") >= F.greatest("n_set", "n_set_b") * similarity - 1e-9
    return sized & (F.least(F.col("n_set") - F.col("place"), F.col("n_set_b") - F.col("place_b")) >= need)


def ordered_ends() -> list[Column]:
    """a, b, low, high of node and node_b."""
    return [f(x, f"{x}_b").alias(c) for c, f, x in (("a", F.least, "node"), ("b", F.greatest, "node"), ("low", F.least, "root"), ("high", F.greatest, "root"))]


def joined_roots(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, root: the roots in ``pairs`` (a, b, low, high) that ``links`` (a, b) join, and the least of what they make."""
    ends = links.join(pairs, ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b"))
    return materialize(components(ends), "roots")


def rerooted(rows: DataFrame, joined: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the roots in ``columns`` replaced by those of the written ``joined``."""
    for c in columns:
        of = broadcast_within(joined.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), BROADCAST_ROWS)
        rows = rows.join(of, c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    return rows


def hub_links(keyed: DataFrame, rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) of the nodes of each large key with the key's hub, and the roots that they join; None without links.

    The hub is the node with the fewest shingles before the key: of edited copies of a text, the least edited one, to which
    those that could share enough with each other are alike as a rule.  So a group that the trees left in many parts
    is joined by a pair a node, before all pairs of different parts are made.
    """
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("place", "node", "root", "n_set")).alias("hub")).filter(F.col("n") > HUB_ROWS)
    hubs = materialize(hubs.select("key", "n", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("place", "node", "root", "n_set")]), "hubs")
    pairs = join_keyed(keyed, hubs, "key").filter((F.col("root") != F.col("root_b")) & enough(similarity))
    pairs = may_be_alike(materialize(pairs.select(*ordered_ends()).distinct(), "hub-pairs"), rows, similarity)
    links = alike(pairs, rows, similarity)
    return None if links.isEmpty() else (links, joined_roots(links, pairs))


def missed_links(rows: DataFrame, similarity: float, chunk: int) -> DataFrame | None:
    """a, b: alike nodes of different roots that join up their groups, among all pairs that share one of their rarest shingles.

    ``rows`` has node, root, hashes, parity and n_set.  Shingles that stand in one group alone have nothing to add, before
    and after the nodes of large keys have met their hubs.  A key of many nodes is met chunk by chunk; a pair that can't
    share enough, by the places of the key in either, is not made.  One pair of each two roots is settled first; what it
    joins need not be compared further.
    """
    rare = rarest(rows, similarity)
    each = rare.select("node", "root", "n_set", F.posexplode("rare").alias("place", "key"))
    mixed = each.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    mixed = materialize(mixed, "mixed-keys")
    if mixed.isEmpty():
        return None
    of = rare.select("node", "root", "n_set")  # met by what is left of the keys, so that these travel alone
    keyed = materialize(each.select("node", "place", "key").join(broadcast_within(mixed, BROADCAST_ROWS), "key"), "mixed-keyed")
    keyed = materialize(keyed.join(of, "node"), "mixed-rows")
    discard(rare)
    found = hub_links(keyed, rows, similarity)
    if found is not None:
        keyed = rerooted(keyed, found[1], "root")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    sizes = materialize(sizes.select("key", "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "key-sizes")
    links = other_links(join_keyed(keyed, sizes, "key"), rows, similarity)
    return links if found is None else found[0].unionByName(links)


def other_links(met: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: alike nodes of different roots that join up their groups, among the nodes that ``met`` brings together by key."""
    met = materialize(met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "met")
    other = met.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("mine"), *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n_set", "place")])
    # Alike texts share at least ``need`` shingles.  After the first they share, neither has fewer than need - 1 left, and the
    # smaller one of the two, which shares a larger part of its own, meets the other within a shorter beginning.
    share = 2 * similarity / (1 + similarity)
    smaller = met.filter(F.col("place") <= F.col("n_set") * (1 - share) + 1e-6)
    first = F.struct("n_set", "node") < F.struct(F.col("n_set_b").alias("n_set"), F.col("node_b").alias("node"))
    pairs = smaller.join(other, ["key", "mine"]).filter(first & (F.col("root") != F.col("root_b")) & enough(similarity))
    pairs = materialize(pairs.select(*ordered_ends()).distinct(), "pairs")
    discard(met)
    pairs = may_be_alike(pairs, rows, similarity)
    one = materialize(pairs.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*"), "first-pairs")
    links = alike(one, rows, similarity)
    rest = pairs.join(one, ["a", "b"], "left_anti")
    if rest.isEmpty():
        return links
    if not links.isEmpty():
        rest = rerooted(rest, joined_roots(links, pairs), "low", "high")
    return links.unionByName(alike(materialize(rest.filter("low <> high").select("a", "b"), "other-pairs"), rows, similarity))


def similar_groups(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    radius: int = WIDE_RADIUS,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk: int = CHUNK,
) -> DataFrame:
    """node, doc_id, text_hash, keep_id, kept: rows grouped by shingle sets of at least the similarity.

    The BK-trees of shards, which are keys of least shingle hashes, find most links, with a wide radius.  Then an exact
    filter by shared shingles finds all pairs that those bounds miss, among texts which are not grouped yet.  Every link
    of either is settled on the whole shingle sets.
    """
    with small_batches(docs.sparkSession):
        rows = materialize(sketches(docs, words, text, doc_id), "sketches")
    links, groups = shard_groups(rows, radius, similarity, chunk)
    missed = missed_links(grouped(rows.select("node", "hashes", "parity", "n_set"), groups), similarity, chunk)
    if missed is not None:
        groups = groups_of(missed if links is None else links.unionByName(missed))
    rooted = materialize(grouped(rows.select("node", "doc_id", "text_hash"), groups), "grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "text_hash")
    several = rooted.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    alone = F.col("first").isNull()
    return join_keyed(rooted, materialize(several, "several"), "root", "left").select(
        "node",
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.when(alone, F.col("text_hash")).otherwise(F.col("first.text_hash")).alias("keep_hash"),
        (alone | (F.col("node") == F.col("first.node"))).alias("kept"),
    )


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of similar texts, with their columns."""
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    doc, text_hash = unused(docs, "gone_doc", "gone_hash")
    with scratch() as keep:
        found = materialize(similar_groups(docs, text=text, doc_id=doc_id, **options), "similar")
        gone = found.filter(~same).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).distinct()
        gone = broadcast_within(keep(materialize(gone, "gone")), BROADCAST_ROWS)
        repeated = not found.filter(~F.col("kept") & same).isEmpty()  # rows that repeat the one that stays
    out = docs.join(
        gone, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of(text)) == F.col(text_hash)), "left_anti"
    )
    return out.dropDuplicates([doc_id, text]) if repeated else out
