"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by cell: source, language and topic.  The weights of
the cells are raked: scaled to meet the targets of one marginal after the
other, round after round, until the largest change is below a tolerance.  A
cell's factor, its raked weight over its tokens, times a common scale is the
chance that each of its documents is drawn.  A document is drawn if a hash of
its id and text, taken as a number from 0 to 1, is below its chance, so the draw
is repeatable and needs no order.

Rare values.  A value that is to have twice its share runs out of documents
when half of the tokens are asked for.  ``beyond`` says what is done then:

* ``"cap"``: it is drawn whole, and what it lacks goes to the other values in
  proportion to their targets; cells are raked below the bound of their tokens.
  The asked share of tokens is drawn, whatever the rarest cell is.
* ``"repeat"``: a chance of 2.3 gives two copies and a third by hash, so targets
  and the asked share both hold, and documents come back (whole epochs).
* ``"less"``: targets hold and no document comes back: the scale is the largest at
  which no chance passes 1, so the rarest cell bounds what is drawn.

The topic is a column of the documents, if one is named; else the group of
length and mean word length, the two measures that need no model: short, middle
or long, plain or dense.

Targets default to tempered shares: the share to the power ``TEMPER``, made to
sum to one, which lifts what is rare.

Scale.  One pass sums the cells, in map tasks first; raking works on cells as
DataFrames, with window sums over each marginal, ``FUSED`` rounds a job.
Drawing is a second pass that meets the cells by a broadcast if they are few
(the number of sources is checked), else by a join that skew handling may split.

Edge cases.  Null text counts as empty and has no tokens; null source or
language is a value of its own.  Cells without tokens have the chance 1.  A
target value without documents is left out and the others scaled up; a value
without a target is not drawn, which with ``"cap"`` bounds the share as well.  Targets
that no weights of the cells there are can meet together end with the last
marginal met (or the bounds of the cells) and the others as near as the rounds
come; raking that still moves after ``ROUNDS`` rounds says so in a warning.  Rows that repeat a doc_id and
text are drawn together.  An empty table gives no rows; columns of ``docs`` are
kept whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.text import text_of, unused
from framewright.storage import broadcast_within, discard, materialize

TEMPER = 0.9
KEEP = 0.8
ROUNDS = 200
FUSED = 4
TOLERANCE = 1e-6
SEED = 17
BROADCAST_ROWS = 100_000
MARGINS = ("source", "language", "topic")


def token_count(text: Column) -> Column:
    """Words: runs of other than ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))).cast("long")


def topic(n_tokens: Column, text: Column) -> Column:
    """Length (to 100 words, to 400, beyond) and mean word length (below 6 bytes, from 6 on)."""
    length = F.when(n_tokens <= 100, "short").when(n_tokens <= 400, "middle").otherwise("long")
    dense = F.octet_length(text) >= 7 * n_tokens
    return F.concat_ws("-", length, F.when(dense, "dense").otherwise("plain"))


def _cell(text: str, source: str, language: str, given: str | None) -> Column:
    """A struct of source, language, topic and tokens."""
    n = token_count(text_of(text))
    named = topic(n, text_of(text)) if given is None else F.coalesce(F.col(given).cast("string"), F.lit("\u0000null"))
    return F.struct(
        F.coalesce(F.col(source).cast("string"), F.lit("\u0000null")).alias("source"),
        F.coalesce(F.col(language).cast("string"), F.lit("\u0000null")).alias("language"),
        named.alias("topic"),
        n.alias("tokens"),
    )


def cells(docs: DataFrame, text: str = "text", source: str = "source", language: str = "lang", topic: str | None = None) -> DataFrame:
    """source, language, topic, tokens: the sums of all documents by cell."""
    summed = docs.select(_cell(text, source, language, topic).alias("cell")).select("cell.*").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    return materialize(summed, "cells")


def tempered(found: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """value, target: shares to the power ``temper``, which sum to one."""
    sums = found.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    power = F.pow(F.col("n").cast("double"), temper)
    total = sums.agg(F.sum(power).alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("value", (power / F.col("all")).alias("target"))  # one row


def level(found: DataFrame, asked: Column, bound: Column, total: float) -> float:
    """The factor at which the sum of least(``bound``, factor * ``asked``) is ``total``, or that at which all bounds are met.

    Starts where no bound counts, and rises as those that are met are taken out, until they stay the same."""
    rows = found.select(asked.alias("asked"), bound.alias("bound")).filter("asked > 0")
    factor, met_before = 0.0, -1
    while True:
        met = F.col("bound") <= F.col("asked") * factor
        n_met, given, rest, most = rows.agg(
            F.count_if(met), F.sum(F.when(met, F.col("bound")).otherwise(0.0)), F.sum(F.when(met, 0.0).otherwise(F.col("asked"))), F.max(F.col("bound") / F.col("asked"))
        ).first()
        if n_met == met_before or most is None:
            return factor
        if not rest or total <= given:
            return most
        factor, met_before = (total - given) / rest, n_met


def within_stock(found: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP) -> tuple[dict[str, DataFrame], float]:
    """The targets that can be had without repeats, and the share of all tokens that they draw: ``keep``, or what the values with a target hold."""
    total = found.agg(F.sum("tokens")).first()[0] or 0
    stock = {m: found.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("n")).join(t, "value").filter("n > 0 and target > 0") for m, t in targets.items()}
    held = [s.agg(F.sum("n")).first()[0] or 0 for s in stock.values()]
    share = min([keep, *(h / total for h in held)]) if total else 0.0
    if not share:
        return targets, 0.0
    bound = F.col("n") / F.lit(share * total)
    return {m: s.select("value", F.least(bound, F.col("target") * level(s, F.col("target"), bound, 1.0)).alias("target")) for m, s in stock.items()}, share


def rake(found: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, share: float | None = None, start: str = "tokens") -> DataFrame:
    """``found`` with weight: of total one, its margins at the targets (value, target), as near to column ``start`` as they allow.

    With ``share``, no weight passes the tokens of its cell over that share of all tokens.  What a bound takes from a
    cell is remembered (``over``) and given back before it is met again, as cyclic projections on inequalities need."""
    now = found.filter("tokens > 0").withColumn("weight", F.col(start).cast("double"))
    if share:
        total = now.agg(F.sum("tokens")).first()[0] or 0
        now = now.withColumn("bound", F.col("tokens") / F.lit(share * total)).withColumn("over", F.lit(1.0))
    for margin, wanted in targets.items():
        named = wanted.select(F.col("value").alias(margin), F.col("target").alias(f"target_{margin}"))
        now = now.join(named, margin, "left").withColumn(f"target_{margin}", F.coalesce(f"target_{margin}", F.lit(0.0)))
    now = materialize(now, "rake")
    moved = None
    for k in range(0, rounds, FUSED):
        after = now
        for _ in range(min(FUSED, rounds - k)):
            after = after.withColumn("was", F.col("weight"))
            for margin in targets:
                has = F.sum("weight").over(Window.partitionBy(margin))
                after = after.withColumn("weight", F.when(has > 0, F.col("weight") * F.col(f"target_{margin}") / has).otherwise(0.0))
            if share:
                after = after.withColumn("held", F.col("weight") * F.col("over")).withColumn("weight", F.least("held", "bound"))
                after = after.withColumn("over", F.when(F.col("weight") > 0, F.col("held") / F.col("weight")).otherwise(1.0)).drop("held")
        before, now = now, materialize(after, "rake")
        discard(before)
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("was")))).first()[0]
        now = now.drop("was")
        if moved is None or moved < tolerance:
            break
    else:
        warnings.warn(f"raking still moves weights by {moved} after {rounds} rounds: the targets can't be met together", stacklevel=2)
    total = now.agg(F.sum("weight")).first()[0] or 1.0  # targets of absent values leave less than one
    return now.select(*found.columns, (F.col("weight") / total).alias("weight"))


def chances(raked: DataFrame, keep: float = KEEP, beyond: str = "less") -> DataFrame:
    """``raked`` with chance: scale x weight / tokens.

    The scale is that at which ``keep`` of all tokens are expected; with ``"less"``, at most the largest at which no chance passes 1.
    With ``"cap"`` chances end at 1, and the scale makes up for it; with ``"repeat"`` they pass 1."""
    factor = F.col("weight") / F.col("tokens")
    most, total = raked.agg(F.max(factor), F.sum("tokens")).first()
    if not most:
        return raked.withColumn("chance", F.lit(0.0))
    scale = keep * total  # weights sum to one, so the scale is what is expected to be drawn
    if beyond == "less":
        scale = min(1 / most, scale)
    if beyond == "cap":
        scale = level(raked, F.col("weight"), F.col("tokens").cast("double"), scale)
    chance = factor * scale
    return raked.withColumn("chance", chance if beyond == "repeat" else F.least(F.lit(1.0), chance))


def calibrated(raked: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, beyond: str = "cap") -> DataFrame:
    """``raked`` with chance.  With ``"cap"``, where the raked weights ask for more than a cell holds, they are raked on from there
    within the stock; weight stays what the targets ask for."""
    if beyond != "cap":
        return chances(raked, keep, beyond)
    most, total = raked.agg(F.max(F.col("weight") / F.col("tokens")), F.sum("tokens")).first()
    if not most or most * keep * total <= 1:
        return chances(raked, keep)
    fitted, share = within_stock(raked, targets, keep)
    held = rake(raked.withColumnRenamed("weight", "goal"), fitted, share=share, start="goal")
    return chances(held, share, "cap").drop("weight").withColumnRenamed("goal", "weight")


def unit_hash(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 to below 1 that the document has by its id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) / F.lit(float(1 << 53))


def draw(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    language: str = "lang",
    topic: str | None = None,
    into: str = "mix",
    beyond: str = "cap",
) -> DataFrame:
    """The documents that are drawn, with struct ``into``: source, language, topic, tokens, weight, chance, copy (from 0)."""
    if beyond not in ("cap", "repeat", "less"):
        raise ValueError(f"beyond is cap, repeat or less, not {beyond}")
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into} already")
    found = cells(docs, text, source, language, topic)
    targets = targets or {m: materialize(tempered(found, m), f"target-{m}") for m in MARGINS}
    raked = materialize(calibrated(rake(found, targets), targets, keep, beyond), "chances")
    key, given, copy = unused(docs.withColumn(into, F.lit(0)), "cell", "given", "copy")
    chance = raked.select(F.struct(*MARGINS).alias(key), F.struct("weight", "chance").alias(given))
    keyed = docs.withColumn(into, _cell(text, source, language, topic))
    met = keyed.join(broadcast_within(chance, BROADCAST_ROWS), F.struct(*[F.col(f"{into}.{m}").alias(m) for m in MARGINS]) == F.col(key), "left")
    likely = F.coalesce(F.col(given)["chance"], F.lit(1.0))
    last = (unit_hash(F.col(doc_id), text_of(text)) < likely - F.floor(likely)).cast("int")
    if beyond == "repeat":
        times = F.floor(likely).cast("int") + last
        drawn = met.filter(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), times - 1)))
    else:
        drawn = met.filter((likely >= 1) | (last == 1)).withColumn(copy, F.lit(0))
    full = F.struct(f"{into}.*", F.coalesce(F.col(given)["weight"], F.lit(0.0)).alias("weight"), likely.alias("chance"), F.col(copy).alias("copy"))
    return drawn.withColumn(into, full).drop(key, given, copy)


def sample_to_targets(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns."""
    (into,) = unused(docs, "mix")
    return draw(docs, into=into, **options).drop(into)
