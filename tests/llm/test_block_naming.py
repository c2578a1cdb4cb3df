from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import block_naming

SCHEMA = "doc_id long, text string, name string, rid int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", " ", "abcd", "ABCD", "abcdefgh", "abcdefghi", "abcdefgh" * 9, "abcdefgh" * 9, "abcdEFGH" * 8, "ÉÈ", "éè",
    "ÉÈa", "ÉÈA", "xyxyxyxyxyxy", "xyxyxyxyxyx", "İ", "i̇", "abcd" * 2, "efghabcd",
]


def expected(rows):
    groups: dict = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault((text or "").translate(LOW), []).append((doc is not None, doc or 0, i, doc))
    out = []
    for text, members in groups.items():
        keep = max(members, key=lambda m: m[:2])[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_hash", [F.xxhash64, lambda c: F.octet_length(c).cast("long")])
def test_against_brute_force(spark, block_hash):
    """The second hash makes blocks of one length collide, so names are told apart by content."""
    rows = list(enumerate(TEXTS)) + [(3, "abcd"), (None, "abcd"), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    out = block_naming.exact_duplicates(docs, block_bytes=4, block_hash=block_hash).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == expected(rows)
    kept = [r for r in out if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in out})


def test_drop_keeps_one_row_of_each_text_with_its_columns(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, "b"), (None, "b"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "n", 7) for d, t in rows], SCHEMA)
    out = block_naming.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "A"), (3, "b"), (5, "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert block_naming.exact_duplicates(docs).collect() == []
    assert block_naming.drop_exact_duplicates(docs).collect() == []


def test_columns_that_clash_with_names_in_use(spark):
    schema = "doc_id long, text string, keep_doc int, Keep_SHA int, block string, h long, n int"
    docs = spark.createDataFrame([(1, "a", 5, 6, "x", 7, 8), (2, "A", 9, 10, "y", 11, 12), (3, "b", 1, 2, "z", 3, 4)], schema)
    out = block_naming.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(2, "A", 9, 10, "y", 11, 12), (3, "b", 1, 2, "z", 3, 4)]


def test_names_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = []
    for parts in (1, 5):
        rows = block_naming.name_documents(docs.repartition(parts), block_bytes=4).collect()
        names.append(sorted((r.doc_id, r.n_blocks, r.name) for r in rows))
    assert names[0] == names[1]


def test_hot_keys_beyond_the_broadcast(spark, monkeypatch):
    """One text of most rows: the same result when its keys are told apart as hot."""
    from framewright.llm import skew

    rows = [(i, "same text of some blocks" if i % 3 else f"own {i}") for i in range(300)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, block_naming.exact_duplicates(docs, block_bytes=4).collect()), key=str)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert sorted(map(tuple, block_naming.exact_duplicates(docs, block_bytes=4).collect()), key=str) == want
    assert sorted([(w[0], w[1], w[2], w[4]) for w in want], key=str) == expected(rows)
