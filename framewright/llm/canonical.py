"""Document fingerprints: canonical exact digests.

A text's canonical form is its compatibility composition (NFKC), lower-cased,
with each run of white space made one space and none at the ends.  The digest
is 128 bits of xxhash of that form's bytes.  Texts with one digest are a
bucket; inside each bucket the bytes are compared, and where a bucket holds
more than one form, the forms are told apart by their rank.  So two
fingerprints are equal exactly when the canonical forms are.  Being exact,
likeness of two fingerprints is 1 or 0: the method does not grade edits.

Scale.  Digests are taken where texts are read.  Only buckets of two or more
rows need their bytes, and a bucket is compared by its least and greatest form,
which map tasks reduce first; no bucket is collected.  Texts that are edited
with their neighbour meet it in a range of doc_ids (at most ``RANGE_IDS`` wide)
by one shuffle of the texts; the first text of each range is sent to the range
before it as well.

Edge cases.  Null text counts as empty.  Empty texts, and texts of white space
alone, are alike.  Rows that repeat a doc_id are ordered by text.  Null doc_ids
come after all others.  A table of one row is its own neighbour; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.text import text_of
from framewright.storage import broadcast_within, materialize

RANGE_ROWS = 256
RANGE_IDS = 1 << 16
BROADCAST_ROWS = 500_000


def canonical(text: Column) -> Column:
    """NFKC, lower case, single spaces.  Texts of ASCII alone are composed as they are."""
    composed = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    )
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)[\s\p{Z}]+", " "))


def wide_xxhash(form: Column) -> Column:
    """128 bits in 32 hex digits: two xxhash64 whose seeds differ."""
    parts = [F.xxhash64(form), F.xxhash64(F.lit("second half"), form)]
    return F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def resolve(digests: DataFrame, forms: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Byte comparison inside equal buckets.

    ``digests`` has a column digest; ``forms`` gives (digest, form) of the rows
    whose digest is in the table handed to it.  Returns the shared digests and,
    if some bucket holds several forms, (digest, form, rank) of those buckets.
    """
    shared = materialize(digests.groupBy("digest").count().filter("count > 1").select("digest"), "shared-digests")
    inside = forms(shared)
    several = inside.groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("b")).filter("a <> b")
    several = materialize(several.select("digest"), "several-forms")
    if several.isEmpty():
        return shared, None
    each = forms(several).distinct()
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("form"))
    return shared, materialize(each.withColumn("rank", rank - 1), "ranked-forms")


def fingerprints(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = wide_xxhash,
) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    forms = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"))
    digested = forms.withColumn("digest", digest(F.col("form")))
    narrow = materialize(digested.select("doc_id", "n_chars", "digest"), "digests")

    def in_buckets(wanted: DataFrame) -> DataFrame:
        return digested.select("digest", "form").join(broadcast_within(wanted, BROADCAST_ROWS), "digest", "left_semi")

    _, ranked = resolve(narrow, in_buckets)
    if ranked is None:
        return narrow.select("doc_id", "n_chars", F.col("digest").alias("fingerprint"))
    told = digested.join(ranked, ["digest", "form"], "left")
    return told.select("doc_id", "n_chars", _name("digest", "rank").alias("fingerprint"))


def _name(digest: str, rank: str) -> Column:
    return F.when(F.coalesce(F.col(rank), F.lit(0)) > 0, F.concat_ws("-", digest, rank)).otherwise(F.col(digest))


def range_above(heads: DataFrame, fan: int = 4096) -> DataFrame:
    """range, above: for each range, the next higher one that has rows; the highest's is null.

    ``heads`` has one column range without repeats.  Ranges are taken ``fan``
    numbers at a time, and the firsts of those groups in the same way, until
    few are left, so that no task orders them all.
    """
    if heads.count() <= fan:
        return heads.withColumn("above", F.lead("range").over(Window.orderBy("range")))
    grouped = heads.withColumn("group", F.floor(F.col("range") / fan))
    inner = grouped.withColumn("above", F.lead("range").over(Window.partitionBy("group").orderBy("range")))
    inner = materialize(inner, "ranges")
    lows = materialize(inner.groupBy("group").agg(F.min("range").alias("low")), "range-groups")
    upper = range_above(lows.select(F.col("group").alias("range")), fan)
    first_above = upper.select(F.col("range").alias("group"), F.col("above").alias("group_above")).join(
        lows.select(F.col("group").alias("group_above"), F.col("low").alias("after")), "group_above"
    )
    return inner.join(first_above.select("group", "after"), "group", "left").select(
        "range", F.coalesce("above", "after").alias("above")
    )


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, next_id, next_text: the next row by descending doc_id; after the last, the first."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = min(RANGE_IDS, max(1, (high - low + 1) * RANGE_ROWS // max(n, 1)))
    place = F.coalesce(F.col("doc_id"), F.lit(low - 1))  # null doc_ids come last
    ranged = rows.withColumn("range", F.floor((place - (low - 1)) / width))
    heads = materialize(ranged.groupBy("range").agg(F.max("doc_id").alias("head")), "range-heads")
    above = range_above(heads.select("range"))
    sent = heads.join(above, "range")
    bottom = heads.agg(F.min("range")).first()[0]
    sent = sent.select("range", "head", F.coalesce("above", F.lit(bottom)).alias("guest_of"))
    sent = broadcast_within(materialize(sent, "guests"), BROADCAST_ROWS)
    guests = ranged.join(sent, ["range"]).filter(F.col("doc_id").eqNullSafe(F.col("head")))
    both = ranged.select("range", "doc_id", "text", F.lit(False).alias("guest")).unionByName(
        guests.select(F.col("guest_of").alias("range"), "doc_id", "text", F.lit(True).alias("guest"))
    )
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        both.withColumns({"next_id": F.lead("doc_id").over(order), "next_text": F.lead("text").over(order)})
        .filter(~F.col("guest"))
        .select("doc_id", "text", "next_id", "next_text")
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half of code points replaced by as many of the first of ``other``, or all of them."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def edit_report(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = wide_xxhash,
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    pairs = with_next(docs, text, doc_id).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    sides = {"digest": "text", "edited_digest": "edited", "next_digest": "next_text"}
    narrow = materialize(
        pairs.select(
            "doc_id",
            "next_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            *[digest(canonical(F.col(c))).alias(k) for k, c in sides.items()],
        ),
        "edit-digests",
    )
    every = narrow.select(F.explode(F.array("digest", "edited_digest")).alias("digest"))

    def in_buckets(wanted: DataFrame) -> DataFrame:
        """Forms of the wanted buckets: of the texts, and of edited texts, for which the two texts are met again."""
        wanted = broadcast_within(wanted, BROADCAST_ROWS)
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
        own = texts.select(canonical(F.col("text")).alias("form")).withColumn("digest", digest(F.col("form")))
        own = own.join(wanted, "digest", "left_semi").select("digest", "form")
        changed = narrow.join(wanted, narrow["edited_digest"] == wanted["digest"], "left_semi")
        changed = materialize(changed.select("doc_id", "next_id", "edited_digest"), "edited-buckets")
        needed = changed.select("doc_id").union(changed.select("next_id")).distinct()
        needed = broadcast_within(materialize(needed, "edited-texts"), BROADCAST_ROWS)
        few = texts.join(needed, texts["doc_id"].eqNullSafe(needed["doc_id"]), "left_semi")
        mine, other = few.alias("m"), few.alias("o")
        made = (
            changed.alias("c")
            .join(mine, F.expr("c.doc_id <=> m.doc_id"))
            .join(other, F.expr("c.next_id <=> o.doc_id"))
            .select("c.edited_digest", canonical(edited(F.col("m.text"), F.col("o.text"))).alias("form"))
            .select(F.col("edited_digest").alias("digest"), "form")
        )
        return own.unionByName(made.filter(digest(F.col("form")) == F.col("digest")))

    _, ranked = resolve(every, in_buckets)
    if ranked is not None:
        told = pairs
        for key, column in sides.items():
            form = f"{key}_form"
            named = ranked.select(F.col("digest").alias(key), F.col("form").alias(form), F.col("rank").alias(f"{key}_rank"))
            told = told.withColumn(form, canonical(F.col(column))).withColumn(key, digest(F.col(form)))
            told = told.join(named, [key, form], "left").withColumn(key, _name(key, f"{key}_rank")).drop(form)
        narrow = told.withColumns(
            {"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}
        )
    like = lambda key: (F.col("digest") == F.col(key)).cast("double")
    return narrow.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("digest").alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"),
        like("edited_digest").alias("near_edited"),
        like("next_digest").alias("near_next"),
    )
