"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of ``block_bytes`` bytes.  Distinct
blocks are sorted, by hash and then by content, and get their places as names;
then adjacent pairs of names get names in the same way, level by level, until
each document has one.  Two texts are equal exactly when they have as many
blocks and the same last name: names are given to the blocks and pairs
themselves, so no two of them can collide, and they follow from the texts
alone, however the rows are dealt.

Scale.  Block contents are shuffled once, after a map-side ``distinct``, so
hot blocks and hot copies shrink to one row a map task.  What follows carries
8-byte keys only: occurrences find the name of their block by its xxhash64;
hashes that two different blocks share are found first, and their blocks are
matched by content.  The levels number log2 of the longest text in blocks, and
only texts of more than one block take part.  Keys that hold many rows, as a
text of many copies has them at each step, are joined by a broadcast (``skew``).

Edge cases.  Null text counts as empty; empty texts are equal to each other.
Rows that repeat a doc_id are rows of their own; among rows with equal text
and the largest doc_id, one stays.  A null doc_id counts as the smallest.  An
empty table gives an empty result.  Extra columns are ignored, and kept by
``drop_exact_duplicates`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.skew import join_keyed
from framewright.llm.text import ascii_lower, text_of, unused
from framewright.storage import broadcast_within, materialize, scratch

BLOCK_BYTES = 4096
BROADCAST_ROWS = 500_000
_NO_PARTNER = -(2**63)


def _blocks(text: Column, block_bytes: int) -> Column:
    """The text's bytes in blocks.  The one-element array binds the text, so that it is evaluated once."""
    return F.transform(
        F.array(text.cast("binary")),
        lambda b: F.transform(
            F.sequence(F.lit(1), F.greatest(F.octet_length(b), F.lit(1)), F.lit(block_bytes)),
            lambda i: F.substring(b, i, F.lit(block_bytes)),
        ),
    )[0]


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """``distinct`` with name: each row's place in the order of its keys, from 0.

    Rows are sorted in ranges; the ranges' sizes, one row a partition, are summed in order.
    """
    placed = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "sorted")
    within = placed.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = within.groupBy("range").agg(F.count("*").alias("size")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return within.join(F.broadcast(sizes), "range").withColumn("name", F.col("before") + F.col("place")).drop("range", "before", "place")


def name_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_sha256, n_blocks, name; (n_blocks, name) is the text's identity."""
    source = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(text_of(text)).alias("norm"))
    blocks = source.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block"))
    distinct = blocks.select(block_hash(F.col("block")).alias("h"), "block").groupBy("h", "block").agg(F.count("*").alias("n"))
    counted = materialize(distinct.groupBy("h").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")), "block-hashes")
    names = materialize(_named(counted.filter("blocks = 1").select("h", "n"), "h"), "block-names")
    shared = materialize(counted.filter("blocks > 1").select("h"), "shared-hashes")
    collided = not shared.isEmpty()

    bound = F.transform(
        F.array("norm"),
        lambda t: F.struct(
            F.unhex(F.sha2(t, 256)).alias("sha"),
            F.transform(_blocks(t, block_bytes), lambda b: block_hash(b)).alias("hs"),
            (_blocks(t, block_bytes) if collided else F.lit(None).cast("array<binary>")).alias("content"),
        ),
    )[0]
    rows = materialize(
        source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", bound.alias("b")).select(
            "rid", "doc_id", "b.sha", F.size("b.hs").alias("n_blocks"), "b.hs", "b.content"
        ),
        "block-rows",
    )

    if collided:
        ours = source.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block"))
        ours = ours.select(block_hash(F.col("block")).alias("h"), "block").distinct().join(shared, "h", "left_semi")
        exact = materialize(_named(ours, "h", "block"), "collided-names")
        exact = exact.select("h", "block", (-1 - F.col("name")).alias("exact"))
        once = rows.select(
            "rid", "n_blocks", F.posexplode(F.arrays_zip("hs", "content")).alias("pos", "z")
        ).select("rid", "n_blocks", "pos", F.col("z.hs").alias("h"), F.col("z.content").alias("block"))
        level = join_keyed(once, names, "h", "left").join(exact, ["h", "block"], "left")
        level = level.select("rid", "n_blocks", "pos", F.coalesce("exact", "name").alias("name"))
    else:
        once = rows.select("rid", "n_blocks", F.posexplode("hs").alias("pos", "h"))
        level = join_keyed(once, names, "h").select("rid", "n_blocks", "pos", "name")
    level = materialize(level, "level-0")

    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    finished, left, depth = [level.filter("n_blocks = 1")], level.filter("n_blocks > 1"), 0
    while longest > 2**depth:
        depth += 1
        half = F.col("pos") % 2
        pairs = (
            left.groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(half == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(_NO_PARTNER)).alias("b"),
            )
        )
        pairs = materialize(pairs, f"pairs-{depth}")
        given = materialize(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b"), f"names-{depth}")
        level = materialize(
            join_keyed(pairs, given, ["a", "b"]).select("rid", "n_blocks", "pos", "name"), f"level-{depth}"
        )
        finished.append(level.filter(F.col("n_blocks") <= 2**depth))
        left = level.filter(F.col("n_blocks") > 2**depth)
    last = finished[0]
    for more in finished[1:]:
        last = last.unionByName(more)
    return rows.select("rid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256")).join(
        last.select("rid", "n_blocks", "name"), "rid"
    )


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    named = materialize(name_documents(docs, text, doc_id, **options), "named")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "rid")
    groups = named.groupBy("n_blocks", "name").agg(F.max(order).alias("top"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1").withColumn("group_size", F.col("n")), "groups")
    alone = F.col("group_size").isNull()
    return join_keyed(named, groups, ["n_blocks", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("top.rid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    key, sha = unused(docs, "keep_doc", "keep_sha")
    with scratch() as keep:
        found = materialize(exact_duplicates(docs, text, doc_id, **options), "exact")
        gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
            F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)
        )
        gone = broadcast_within(keep(materialize(gone.distinct(), "gone")), BROADCAST_ROWS)
        repeated = found.filter("NOT kept").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        repeated = not repeated.isEmpty()  # rows that repeat the doc_id of the row that stays
    mine = docs.withColumn(sha, F.sha2(ascii_lower(text_of(text)), 256)).alias("d")
    out = mine.join(
        gone.alias("g"),
        F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"g.{key}")) & (F.col(f"d.{sha}") == F.col(f"g.{sha}")),
        "left_anti",
    )
    if repeated:
        out = out.dropDuplicates([doc_id, sha])
    return out.drop(sha)
