"""Personal data, and information-theoretic sanitisation of what discloses it.

Base entities are e-mail addresses, IP addresses, card numbers and telephone
numbers, found by pattern and checked.  Other words of the corpus may disclose
them.  Counting distinct texts, a term t tells of a protected entity e

    PMI(t, e) = IC(e) - left(t, e),    IC(e) = -log2 p(e),    left(t, e) = -log2 p(e | t)

bits; ``left`` is what remains unknown of e once t is seen.  p(e | t) is the
share of the texts with t that hold e, drawn towards p(e) by ``SMOOTHING``
texts, so that few texts are weak evidence: a term that stands in one text
only, or in two, leaves 1.46 or 0.91 bits of a rare value and is kept, however
close it stands to the value.  Above the disclosure thresholds, that is with at most
``GENERALISE`` bits left (a term seen with a rare value in three texts to six, and
never without it), a term is replaced by its kind; with at most ``REMOVE`` (seven
texts or more), it is removed.  It must also reveal half of IC(e), so that what
most texts hold is not disclosed by every word.

What is protected: each value; values that always stand in the same texts are
linked and count as one entity.  Also each kind as such, in the texts that hold
it, with more smoothing (``KIND_SMOOTHING``), as chance meets kinds more often
than values.  Terms are runs of letters outside of addresses, in lower case,
over whole texts.  A term that discloses a value is marked wherever it stands,
also in texts without the value.

Everything is Spark's own functions.  A running sum over an array, such as the
places of matches, goes block by block, so that no array grows by one element
at a time over its whole length; the patterns are written so that no text makes
them backtrack far.

Scale.  Rows are numbered and written once, and every pass reads them there, so
that a number names the same text whatever the input's plan is.  One pass finds
the entities and writes a row per document; only rows with entities carry their
text and words on.  Terms are counted over all distinct texts in a second pass,
and over those with entities, both combined in map tasks; the two counts of a
term bound what it can disclose at best.  Only terms beyond that bound meet the
entities of their texts, so a text of many values and many words makes no
product of both.  Kinds, of which there are four, are met by a broadcast.
Places follow from the words that were written.  A further pass looks
for the terms that also stand in texts without the value; they are few, and
broadcast if their number is below ``BROADCAST_ROWS``.  Copies of a text are
told by their least row, so no join has a key with many rows of one text.

Edge cases.  Null text counts as empty.  Rows that repeat a doc_id get a row
each.  A text may hold any number of spans.  Spans that overlap are all
reported; in the sanitised text the first that starts is applied, and those
that begin inside it are part of it.  Equal texts count once.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.skew import join_keyed
from framewright.llm.text import text_of
from framewright.storage import broadcast_within, materialize

SMOOTHING = 1.75
KIND_SMOOTHING = 8.0
GENERALISE = 0.7
REMOVE = 0.35
LEAST_SHARE = 0.5
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
SCAN_BLOCK = 256
EDIT_BLOCK = 4096

_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: kind, what a text must hold, pattern.  The look-behinds keep a search from starting again inside a run it has
#: already tried; ``\G`` lets one start where the match before ended.
PATTERNS = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
KINDS = [kind for kind, _, _ in PATTERNS]
_SIXTEEN_DIGITS = r"[0-9](?:[\x20-]?[0-9]){15}"
_WORD = r"\p{L}++"
_ADDRESS_OR_WORD = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|" + _WORD

_SPAN = "struct<start:int,end:int,value:string>"
_ADDED = "struct<start:int,end:int,left:double,revealed:double>"
_EDIT = "struct<start:int,end:int,put:string>"


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches, and what lies between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, also where lambda functions refer to it."""
    return F.transform(F.array(value), use)[0]


def running(n: Column, first: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Elements that ``step`` emits for 1 to ``n`` in turn.

    ``step`` takes what is carried and the number, and gives a struct of ``at``, what is carried on, and ``out``, an
    array of none or one element of type ``kind``.  Arrays grow within blocks only, so the cost is linear in ``n``.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, i: Column) -> Column:
        made = step(acc["at"], i)
        return F.struct(made["at"].alias("at"), F.concat(acc["out"], made["out"]).alias("out"))

    def block(acc: Column, begin: Column) -> Column:
        inside = F.aggregate(
            F.sequence(begin, F.least(begin + SCAN_BLOCK - 1, n)), F.struct(acc["at"].alias("at"), none.alias("out")), one
        )
        return F.struct(inside["at"].alias("at"), F.concat(acc["out"], F.array(inside["out"])).alias("out"))

    start = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = F.flatten(F.aggregate(F.sequence(F.lit(1), n, F.lit(SCAN_BLOCK)), start, block)["out"])
    return F.when(n > 0, whole).otherwise(none)


def positions(found: Column, between: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Start, end (code points, end exclusive) and value of each match, or of those whose value ``keep`` holds for."""

    def step(b: Column, at: Column, i: Column) -> Column:
        value = F.element_at(b["found"], i)
        begin = at + F.char_length(F.element_at(b["between"], i))
        end = begin + F.char_length(value)
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), value.alias("value")))
        out = span if keep is None else F.when(keep(value), span).otherwise(F.array().cast(f"array<{_SPAN}>"))
        return F.struct(end.alias("at"), out.alias("out"))

    both = F.struct(found.alias("found"), between.alias("between"))
    return bound(both, lambda b: running(F.size(b["found"]), F.lit(0), lambda at, i: step(b, at, i), _SPAN))


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits),
        "phone": n.between(8, 15),
    }[kind]


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
    )


def with_base(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text, not null) and, for each kind, its valid spans in order."""
    text = F.col("text")
    columns = {}
    for kind, needs, pattern in PATTERNS:
        may = text.rlike(_SIXTEEN_DIGITS) if needs is None else F.contains(text, F.lit(needs))
        found, between = matches(text, pattern)
        columns[f"m_{kind}"] = F.when(may, found)
        columns[f"g_{kind}"] = F.when(may, between)
    out = rows.withColumns(columns)
    none = F.array().cast(f"array<{_SPAN}>")
    spans = {
        kind: F.when(F.size(f"m_{kind}") > 0, positions(F.col(f"m_{kind}"), F.col(f"g_{kind}"), lambda v, k=kind: valid(k, v))).otherwise(none)
        for kind in KINDS
    }
    return out.withColumns(spans).drop(*columns)


def _named(kind: str | Column, spans: Column) -> Column:
    """kind:start:end of each span."""
    label = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", label, s["start"].cast("string"), s["end"].cast("string")))


def _words(text: Column) -> Column:
    """The runs of letters outside of addresses, and the addresses."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(_ADDRESS_OR_WORD), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    )


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; addresses count as terms that no row of ``found`` has."""
    words = _words(text)
    return F.when(F.size(words) > 0, F.array_distinct(F.split(F.lower(F.array_join(words, " ")), " ")))


def term_spans(text: Column) -> Column:
    """Start, end and value (in lower case) of each term."""
    between = F.when(F.contains(text, F.lit("@")), F.split(text, _ADDRESS_OR_WORD, -1)).otherwise(F.split(text, _WORD, -1))
    found = positions(_words(text), between, lambda v: ~F.contains(v, F.lit("@")))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id and text of every row, written once: a number stays with its text."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), "numbered")


def find(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows`` (as ``numbered`` gives), written: rid, doc_id, text_hash, text_sha256, n_<kind>, base (spans in order).

    Rows that have entities also have their names (kind and value), the kinds, the text and its terms' spans.
    """
    based = with_base(rows).withColumn("base", F.concat(*[F.transform(F.col(k), _of_kind(k)) for k in KINDS]))
    some = F.size("base") > 0
    names = F.transform("base", lambda e: F.concat_ws(":", e["kind"], F.lower(e["value"])))
    return materialize(
        based.select(
            "rid",
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            F.sha2("text", 256).alias("text_sha256"),
            *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
            F.transform("base", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"))).alias("base"),
            F.when(some, F.array_distinct(names)).alias("names"),
            F.when(some, F.array_compact(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in KINDS]))).alias("kinds"),
            F.when(some, F.col("text")).alias("text"),
            F.when(some, term_spans(F.col("text"))).alias("terms"),
        ),
        "entities",
    )


def linked(found: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with entities (rid, head, terms, units), and the units (unit, own, kind).

    A unit is what is protected: values that stand in the same distinct texts, or a kind.  ``heads`` has the rid of the
    first row of each text; ``own`` counts the distinct texts that hold the unit.
    """
    with_some = found.filter(F.col("names").isNotNull())
    first = heads.select("rid", F.lit(True).alias("head"))
    held = with_some.select("rid", "text_hash", "names", "kinds").join(first, "rid", "left").withColumn("head", F.coalesce("head", F.lit(False)))
    held = materialize(held, "held")
    each = held.select("rid", "text_hash", "head", F.explode("names").alias("name"))
    texts = [F.bit_xor(F.when(F.col("head"), F.xxhash64(F.lit(k), F.col("text_hash")))) for k in (1, 2)]
    by_name = each.groupBy("name").agg(F.count_if("head").alias("own"), F.count("*").alias("n"), F.xxhash64(F.count_if("head"), *texts).alias("unit"))
    by_name = materialize(by_name, "units")
    of_kind = held.filter("head").select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("own"))
    units = by_name.groupBy("unit").agg(F.max("own").alias("own"), F.lit(False).alias("kind"))
    units = units.unionByName(of_kind.select(F.xxhash64("kind").alias("unit"), "own", F.lit(True).alias("kind")))
    named = join_keyed(each.select("rid", "name"), by_name.select("name", "unit", "n"), "name")
    of_row = named.select("rid", "unit").union(held.select("rid", F.explode("kinds").alias("kind")).select("rid", F.xxhash64("kind").alias("unit")))
    of_row = of_row.groupBy("rid").agg(F.collect_set("unit").alias("units"))  # at most the entities of a text
    rows = with_some.select("rid", "terms").join(held.select("rid", "head"), "rid").join(of_row, "rid")
    return materialize(rows, "linked"), materialize(units, "protected")


def _reaches(both: Column, texts: Column, prior: Column | float, pseudo: Column | float) -> Column:
    """The smoothed p(e | t)."""
    return (both + pseudo * prior) / (texts + pseudo)


def disclosing_terms(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``linked``, and unit, term, left, revealed, elsewhere of the pairs beyond the disclosure threshold.

    ``elsewhere``: the term also stands in texts without the value.
    """
    heads = materialize(found.groupBy("text_hash").agg(F.min("rid").alias("rid")).select("rid"), "first-rows")
    total = float(max(heads.count(), 1))
    repeats = materialize(found.select("rid").join(heads, "rid", "left_anti"), "repeats")
    with_units, units = linked(found, heads)
    words = F.explode(F.array_distinct(F.transform("terms", lambda s: s["value"]))).alias("term")
    words = materialize(with_units.filter("head").select("rid", words), "words-near")
    most = words.groupBy("term").agg(F.count("*").alias("most"))
    once = rows.join(broadcast_within(repeats, BROADCAST_ROWS), "rid", "left_anti")
    counts = once.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    # No unit is in more texts than the largest of its sort, nor with a term in more texts than have entities.
    tops = {r.kind: r.own / total for r in units.groupBy("kind").agg(F.max("own").alias("own")).collect()}
    sorts = [(False, SMOOTHING), (True, KIND_SMOOTHING)]
    best = F.greatest(*[_reaches(F.col("most"), F.col("texts"), tops.get(kind, 0.0), pseudo) for kind, pseudo in sorts])
    few = materialize(most.join(counts, "term").filter(best >= 2**-GENERALISE).select("term", "texts"), "candidate-terms")
    near = words.join(broadcast_within(few.select("term"), BROADCAST_ROWS), "term")
    pairs = near.join(with_units.select("rid", F.explode("units").alias("unit")), "rid").groupBy("unit", "term").agg(F.count("*").alias("both"))
    pairs = materialize(pairs.join(few, "term"), "pairs")
    of_kinds = F.broadcast(units.filter("kind"))  # at most four
    met = pairs.join(of_kinds, "unit").unionByName(pairs.join(units.filter("NOT kind"), "unit"))
    prior = F.col("own") / F.lit(total)
    pseudo = F.when(F.col("kind"), KIND_SMOOTHING).otherwise(SMOOTHING)
    left = -F.log2(_reaches(F.col("both"), F.col("texts"), prior, pseudo))
    content = -F.log2(prior)
    revealed = F.when(content > 0, 1 - left / content).otherwise(0.0)
    scored = met.select(
        "unit", "term", left.alias("left"), revealed.alias("revealed"), (~F.col("kind") & (F.col("texts") > F.col("both"))).alias("elsewhere")
    )
    return with_units, materialize(scored.filter((F.col("left") <= GENERALISE) & (F.col("revealed") >= LEAST_SHARE)), "disclosing-terms")


def added_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rid, added (start, end, left, revealed of its disclosing terms, in order), text (where ``found`` has none)."""
    with_units, terms = disclosing_terms(rows, found)
    inside = with_units.select("rid", F.explode("terms").alias("t")).select("rid", F.col("t.start"), F.col("t.end"), F.col("t.value").alias("term"))
    inside = inside.join(broadcast_within(terms, BROADCAST_ROWS), "term")
    of_row = with_units.select("rid", F.explode("units").alias("unit"))
    spans = inside.join(of_row, ["rid", "unit"]).select("rid", "start", "end", "left", "revealed")
    away = terms.filter("elsewhere").groupBy("term").agg(F.min("left").alias("left"), F.max("revealed").alias("revealed"))
    away = materialize(away, "terms-elsewhere")
    whole = None
    if not away.isEmpty():
        away = broadcast_within(away, BROADCAST_ROWS)
        each = rows.select("rid", F.explode(terms_of(F.col("text"))).alias("term")).join(away.select("term"), "term")
        hits = materialize(each.groupBy("rid").agg(F.collect_list("term").alias("hits")), "rows-elsewhere")  # each a distinct term of a text
        there = rows.join(broadcast_within(hits, BROADCAST_ROWS), "rid")
        of_hits = F.filter(term_spans(F.col("text")), lambda s: F.array_contains("hits", s["value"]))
        whole = materialize(there.select("rid", "text", of_hits.alias("terms")), "texts-elsewhere")
        outside = whole.select("rid", F.explode("terms").alias("t")).select("rid", F.col("t.start"), F.col("t.end"), F.col("t.value").alias("term"))
        spans = spans.unionByName(outside.join(away, "term").select("rid", "start", "end", "left", "revealed"))
    each = spans.groupBy("rid", "start", "end").agg(F.min("left").alias("left"), F.max("revealed").alias("revealed"))
    out = each.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "left", "revealed"))).alias("added"))
    texts = F.lit(None).cast("string").alias("other")
    out = out.select("rid", "added", texts) if whole is None else out.join(whole.select("rid", F.col("text").alias("other")), "rid", "left")
    return materialize(out, "added-spans")


def _edited(text: Column, edits: Column) -> Column:
    """``text`` with each edit's span replaced by what it puts; edits are in order and do not overlap.

    The text is cut into blocks, so that no edit searches the text from its beginning; an edit over a border is cut too.
    """

    def cut(e: Column) -> Column:
        first = F.floor(e["start"] / EDIT_BLOCK).cast("int")
        return F.transform(
            F.sequence(first, F.floor((e["end"] - 1) / EDIT_BLOCK).cast("int")),
            lambda b: F.struct(
                b.alias("block"),
                F.greatest(e["start"] - b * EDIT_BLOCK, F.lit(0)).alias("start"),
                F.least(e["end"] - b * EDIT_BLOCK, F.lit(EDIT_BLOCK)).alias("end"),
                F.when(b == first, e["put"]).otherwise("").alias("put"),
            ),
        )

    def put(inside: Column, acc: Column, p: Column) -> Column:
        kept = F.substring(inside, acc["at"] + 1, p["start"] - acc["at"])
        return F.struct(p["end"].alias("at"), F.concat(acc["out"], kept, p["put"]).alias("out"))

    def of_block(whole: Column, b: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        here = F.filter(whole["parts"], lambda p: p["block"] == b)
        return bound(
            F.substring(whole["text"], b * EDIT_BLOCK + 1, F.lit(EDIT_BLOCK)),
            lambda inside: bound(
                F.aggregate(here, begin, lambda acc, p: put(inside, acc, p)),
                lambda done: F.concat(done["out"], F.substring(inside, done["at"] + 1, F.lit(EDIT_BLOCK))),
            ),
        )

    last = F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / EDIT_BLOCK).cast("int")
    value = F.struct(text.alias("text"), F.flatten(F.transform(edits, cut)).alias("parts"))
    return bound(value, lambda whole: F.array_join(F.transform(F.sequence(F.lit(0), last), lambda b: of_block(whole, b)), ""))


def _edits(base: Column, added: Column) -> Column:
    """What is put for each span: in order, less those that begin inside one before."""
    of_base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    of_term = F.transform(
        added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["left"] <= REMOVE, "").otherwise("[TERM]").alias("put"))
    )

    def step(ordered: Column, at: Column, i: Column) -> Column:
        e = F.element_at(ordered, i)
        taken = e["start"] >= at
        return F.struct(F.when(taken, e["end"]).otherwise(at).alias("at"), F.when(taken, F.array(e)).otherwise(F.array().cast(f"array<{_EDIT}>")).alias("out"))

    both = F.sort_array(F.concat(of_base, of_term))
    return bound(both, lambda o: running(F.size(o), F.lit(0), lambda at, i: step(o, at, i), _EDIT))


def _sanitised(numbers: DataFrame) -> DataFrame:
    """The rows of ``find`` with added spans and ``clean``, the sanitised text of those that it changes."""
    found = find(numbers)
    added = added_spans(numbers, found)
    rows = found.drop("names", "kinds", "terms").join(added, "rid", "left")
    rows = rows.withColumns({"added": F.coalesce("added", F.array().cast(f"array<{_ADDED}>")), "text": F.coalesce("text", "other")})
    rows = rows.withColumn("edits", F.when(F.col("text").isNotNull(), _edits(F.col("base"), F.col("added"))))
    return rows.withColumn("clean", F.when(F.size("edits") > 0, _edited(F.col("text"), F.col("edits"))))


def _action(s: Column) -> Column:
    return F.concat_ws(
        ":",
        s["start"].cast("string"),
        s["end"].cast("string"),
        F.when(s["left"] <= REMOVE, "remove").otherwise("generalise"),
        F.format_string("%.3f", s["revealed"]),
    )


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_term, spans, actions, sanitised_sha256 of every row.

    ``spans`` lists base spans, then the method's as kind ``term``; ``actions`` lists start, end, what is done and the
    share of information that the term reveals.
    """
    rows = _sanitised(numbered(docs, text, doc_id))
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return rows.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.size("added").cast("long").alias("n_term"),
        F.array_join(F.concat(base, _named("term", F.col("added"))), ",").alias("spans"),
        F.array_join(F.transform("added", _action), ",").alias("actions"),
        F.when(F.col("clean").isNull(), F.col("text_sha256")).otherwise(F.sha2("clean", 256)).alias("sanitised_sha256"),
    )


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and sanitised text: entities and generalised terms as their kind in brackets, removed terms as nothing."""
    rows = numbered(docs, text, doc_id)
    changed = materialize(_sanitised(rows).filter(F.col("clean").isNotNull()).select("rid", "clean"), "changed-texts")
    size = changed.agg(F.coalesce(F.sum(F.octet_length("clean") + 16), F.lit(0))).first()[0]
    met = rows.join(F.broadcast(changed) if size <= BROADCAST_BYTES else changed, "rid", "left")
    return met.select("doc_id", F.coalesce("clean", "text").alias("text"))
