"""Spelling variants: words one edit apart, grouped under their frequent forms.

One edit leaves a half of a word intact.  Of two words, the shorter (or either, if they are equally long) has m code points;
the edit lies before or after its middle.  So the two share a prefix of m // 2 code points, or the suffix that is the rest.  A
word enters the forward dictionary, sorted by such prefixes, and the reversed one, sorted by suffixes, once for words of its
own length or longer by one (m is its length) and once for words shorter by one.  A block is a range of equal (m, prefix) or
(m, suffix).

Blocks of more than ``MOST`` words are subdivided: what remains between the shared prefix and the shared suffix is halved
again, and each word goes to two narrower blocks.  That ends when at most one code point of the shorter word is open, where a
block holds no more words than the alphabet allows.  A block that is small enough is scanned and its pairs are verified.  Each
near pair is taken in one block only: the one that its longest common prefix leads to.

Scale.  Runs are counted in map tasks first; then everything works on distinct words.  Sizes of blocks are counted before
any block is gathered, and large ones are known to all tasks by a broadcast of checked size or a join (see ``skew``), so no task
gathers more than ``MOST`` words of a divisible block.  Words of no block with company are dropped at once.  Each level and each
round of pointers is written.

Edge cases.  Null texts have no runs, as have empty ones; a null doc_id counts as empty in the hash.  Rows that repeat a doc_id
count each.  Ties of the most frequent near word go to the smallest in code-point order.  A word of any length is one word.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.memory import frugal
from framewright.llm.skew import join_keyed
from framewright.llm.text import ascii_lower
from framewright.storage import materialize

RUNS = "[a-zÀ-ÿ]+"
SLIP = 97
LEAST_LENGTH = 5
LEAST_TIMES = 3
MOST = 64
FACTOR = 2
BLOCK = ["m", "a", "b", "key"]
_NEAR = "word string, near string, near_n long"


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES
) -> DataFrame:
    """word, n of all words; one run in ``SLIP``, by hash of doc_id and run, has lost a code point."""
    owner = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(owner.alias("owner"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUNS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("owner", F.lit(":"), "run").cast("binary"))
    runs = runs.filter(F.char_length("run") >= least_length).select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, lost).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_times)


def _keyed(rows: DataFrame, m: Column, a: Column, b: Column) -> Column:
    key = F.concat(F.substring("word", F.lit(1), a), F.when(b > 0, F.substring("word", -b, b)).otherwise(""))
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"), key.alias("key"))


def first_blocks(words: DataFrame) -> DataFrame:
    """m, a, b, key, word, n: the entries of all words in the forward and the reversed dictionary.

    A block's words share a prefix of ``a`` and a suffix of ``b`` code points, and have m or m + 1.
    """
    length = F.char_length("word")
    roles = []
    for m in (length, length - 1):
        half = F.floor(m / 2).cast("int")
        roles += [_keyed(words, m, half, F.lit(0)), _keyed(words, m, F.lit(0), m - half)]
    return words.select("word", "n", F.explode(F.array(*roles)).alias("block")).select("block.*", "word", "n")


def narrower(entries: DataFrame) -> DataFrame:
    """The entries of blocks that are subdivided: the open middle is halved, and one half is shared."""
    middle = (F.col("a") + F.floor((F.col("m") - F.col("a") - F.col("b")) / 2)).cast("int")
    left, right = _keyed(entries, F.col("m"), middle, F.col("b")), _keyed(entries, F.col("m"), F.col("a"), F.col("m") - middle)
    return entries.select("word", "n", F.explode(F.array(left, right)).alias("block")).select("block.*", "word", "n")


def common_prefix(u: str, v: str, start: int) -> int:
    """The length of the longest common prefix, known to be ``start`` at least; ``u`` is not the longer."""
    end = len(u)
    while start < end and u[start] == v[start]:
        start += 1
    return start


def near_in_block(m: int, a: int, b: int, words: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """The near pairs of a block that no other block takes."""
    upto = m - b if b else m + 1
    short = [(w, n) for w, n in words if len(w) == m]
    long = [(w, n) for w, n in words if len(w) != m]
    for k, (u, n) in enumerate(short):
        for others, skip in ((short[k + 1 :], 1), (long, 0)):
            for v, v_n in others:
                p = common_prefix(u, v, a)
                if p < upto and u[p + skip :] == v[p + 1 :]:
                    yield u, n, v, v_n


def scanned(entries: DataFrame) -> DataFrame:
    """word, near, near_n, both ways, of the near pairs of all blocks; ``entries`` are of blocks that a task can gather."""

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle() -> list[tuple[str, str, int]]:
            found = list(near_in_block(*at[:3], held)) if len(held) > 1 else []
            return [(u, v, v_n) for u, _, v, v_n in found] + [(v, u, n) for u, n, v, _ in found]

        def out(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "near", "near_n"])

        for batch in batches:
            rows = []
            for *block, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    rows += settle()
                    at, held = block, []
                held.append((word, n))
            if rows:
                yield out(rows)
        if rows := settle():
            yield out(rows)

    return entries.select(*BLOCK, "word", "n").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "word").mapInArrow(scan, _NEAR)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n of all pairs of words exactly one edit apart, both ways; ``words`` is a written table of word, n."""
    entries, found = first_blocks(words), []
    while True:
        sizes = entries.groupBy(*BLOCK).agg(F.count("*").alias("size")).filter("size > 1")
        large = (F.col("size") > most) & (F.col("m") - F.col("a") - F.col("b") > 1)
        sizes = materialize(sizes.withColumn("large", large), "block-sizes")
        met = materialize(join_keyed(entries, sizes, BLOCK, size="size"), "blocks")
        found.append(scanned(met.filter("NOT large")))
        if sizes.filter("large").isEmpty():
            break
        entries = narrower(met.filter("large"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word, root of the words in ``forms`` (word, form; a form is more frequent, so there are no circles).

    Each round every word points where its target points, so chains halve.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "pointers")
    for _ in range(most_rounds):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        at = materialize(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "pointers")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")
    raise RuntimeError(f"forms did not settle in {most_rounds} rounds")


def variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_times: int = LEAST_TIMES,
    factor: float = FACTOR,
    most: int = MOST,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    words = materialize(word_counts(docs, text, doc_id, least_length, least_times), "words")
    near = near_words(words, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best")
    )
    met = words.join(near, "word", "left")
    wins = -F.col("best.n") >= factor * F.col("n")
    told = met.select(
        "word",
        F.when(wins, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, -F.col("best.n")).alias("form_n"),
    )
    told = materialize(told, "forms")
    led = roots(told.filter(F.col("form").isNotNull()))
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
