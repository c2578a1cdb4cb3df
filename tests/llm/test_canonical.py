from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from framewright.llm import canonical

SCHEMA = "doc_id long, text string, range string, digest int"
TEXTS = [
    None, "", " \n\t", "Abc  d", "abc d", " ABC\nD ", "é", "é", "É", "ﬁn", "fin", " x y", "x y", "z" * 50,
    "日本語テキスト", "half and half and half", "İ", "straße", "á̧", "á̧",
]


def form(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip(" ")


def changed(a, b):
    a, b = a or "", b or ""
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_canonical_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    for r in df.select("text", canonical.canonical(F.col("text")).alias("form")).collect():
        assert r.form == form(r.text), repr(r.text)


@pytest.mark.parametrize("digest", [canonical.wide_xxhash, lambda c: F.char_length(c).cast("string")])
def test_report_against_brute_force(spark, digest, monkeypatch):
    """The second digest puts forms of one length into a bucket, so the bytes must tell them apart."""
    monkeypatch.setattr(canonical, "RANGE_ROWS", 3)
    rows = [(i * 7 % 100, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    out = {r.doc_id: r for r in canonical.edit_report(docs, digest=digest).collect()}
    ordered = sorted(rows, reverse=True)
    names: dict = {}
    for (d, t), (e, u) in zip(ordered, ordered[1:] + ordered[:1]):
        edit = changed(t, u)
        assert out[d].n_chars == len(t or "")
        assert out[d].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert out[d].near_edited == float(form(t) == form(edit))
        assert out[d].near_next == float(form(t) == form(u))
        names.setdefault(form(t), set()).add(out[d].fingerprint)
        names.setdefault(form(edit), set()).add(out[d].edited_fingerprint)
    assert all(len(x) == 1 for x in names.values())
    assert len({next(iter(x)) for x in names.values()}) == len(names)


@pytest.mark.parametrize("digest", [canonical.wide_xxhash, lambda c: F.char_length(c).cast("string")])
def test_fingerprints_are_equal_when_the_forms_are(spark, digest):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "twice", None, None)], SCHEMA)
    by_form: dict = {}
    texts = dict(enumerate(TEXTS))
    for r in canonical.fingerprints(docs, digest=digest).collect():
        if r.doc_id != 3:
            by_form.setdefault(form(texts[r.doc_id]), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_form.values())
    assert len({next(iter(x)) for x in by_form.values()}) == len(by_form)


def test_next_row_with_repeats_nulls_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(canonical, "RANGE_ROWS", 2)
    rows = [(900_000, "a"), (5, "b"), (5, "c"), (4, "d"), (None, "e"), (-70_000, "f"), (6, None)]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA)
    got = {(r.doc_id, r.text): (r.next_id, r.next_text) for r in canonical.with_next(docs).collect()}
    order = [(900_000, "a"), (6, ""), (5, "b"), (5, "c"), (4, "d"), (-70_000, "f"), (None, "e")]
    assert got == dict(zip(order, order[1:] + order[:1]))
    one = canonical.with_next(docs.filter("doc_id = 4")).collect()
    assert [tuple(r) for r in one] == [(4, "d", 4, "d")]


def test_ranges_above_in_levels(spark):
    heads = spark.createDataFrame([(x,) for x in (0, 1, 5, 9, 30, 31, 200, 777)], "range long")
    got = {r.range: r.above for r in canonical.range_above(heads, 3).collect()}
    assert got == {0: 1, 1: 5, 5: 9, 9: 30, 30: 31, 31: 200, 200: 777, 777: None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert canonical.edit_report(docs).collect() == []
    assert canonical.fingerprints(docs).collect() == []
