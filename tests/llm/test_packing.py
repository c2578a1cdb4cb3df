from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from framewright.llm import packing
from framewright.llm.registry import tokenizer_file
from framewright.llm.units import Encoder, units

SCHEMA = "doc_id long, text string, piece string"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n  c", "x's 's\n's  's", "don't  'll 've", "\n\n \n a\t\t b",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>  b", "é è  ñ", "1 22  333.4", "end \n", "a\x1c b", "a  b",
    "!!! ?? 'tis 'S", "ß" * 300, "word " * 40, " " * 700,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_units_join_to_the_text_and_encode_as_the_library(library):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "1", ".", "é", "<|endoftext|>"]) for _ in range(40)) for _ in range(300)]
    encode = Encoder(tokenizer_file())
    for text in ODD + made:
        assert " ".join(units(text)) == text
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cut_leaves_the_rest_to_the_first_piece():
    assert packing.cut(2048, 2048) == [0, 2048]
    assert packing.cut(4096, 2048) == [0, 2048, 4096]
    assert packing.cut(4100, 2048) == [0, 4, 2052, 4100]


def test_best_fit_and_local_search_keep_all_pieces_and_fill_the_bins():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.Bins(sizes, 100)
    bins.best_fit()
    before = sum(f * f for f in bins.fill)
    used = sum(1 for f in bins.fill if f)
    bins.local_search()
    assert sum(f * f for f in bins.fill) >= before
    assert sum(1 for f in bins.fill if f) <= used
    assert sorted(i for x in bins.items for i in x) == list(range(500))
    assert all(sum(sizes[i] for i in x) == f <= 100 for x, f in zip(bins.items, bins.fill, strict=True))


def test_local_search_empties_a_bin_by_an_exchange():
    bins = packing.Bins([6, 3, 4, 4, 3], 10)  # 6+3 | 4+4 | 3 packs into two only by exchanging
    bins.items, bins.fill = [[0, 1], [2, 3], [4]], [9, 8, 3]
    bins.local_search()
    assert sorted(f for f in bins.fill if f) == [10, 10]


def test_search_ends_where_nothing_can_be_gained():
    bins = packing.Bins([1025 + k % 1000 for k in range(6000)], 2048)
    bins.best_fit()
    bins.local_search()
    assert len(bins.items) == 6000 and all(len(x) == 1 for x in bins.items)


def test_search_ends_at_a_local_optimum():
    """No move, exchange one for one or two for one that raises the sum of squares is left, unless the bins are the fewest."""
    for seed in range(12):
        rng = random.Random(seed)
        bins = packing.Bins([rng.randint(20, 60) for _ in range(40)], 100)
        bins.best_fit()
        bins.local_search()
        if sum(1 for f in bins.fill if f) == -(-sum(bins.sizes) // 100):
            continue
        for a, mine in enumerate(bins.items):
            for b, theirs in enumerate(bins.items):
                if a == b or not bins.fill[a] or not bins.fill[a] <= bins.fill[b] < 100 or bins.fill[a] == 100:
                    continue
                give = [bins.sizes[i] for i in mine] + [bins.sizes[i] + bins.sizes[j] for i in mine for j in mine if i < j]
                take = [0] + [bins.sizes[i] for i in theirs]
                assert not any(0 < g - t <= 100 - bins.fill[b] for g in give for t in take)


def test_query_against_a_plain_reading(spark, library):
    texts = {i: t for i, t in enumerate(ODD)} | {100: None, 101: "to be or not " * 900}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(7, "twice", "x"), (None, "no id", None)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), tokenizer_file(), 128).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        if i == 7:
            continue
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        at = packing.cut(len(ids), 128)
        assert [(r.start, r.length) for r in got] == [(a, b - a) for a, b in zip(at, at[1:])]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
    assert len(by_doc[7]) == 2 and len(by_doc[None]) == 1
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in out)
    assert len(bins) <= total / 128 + 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_file()).collect() == []


def test_groups_get_numbers_of_their_own(spark):
    pieces = spark.createDataFrame([Row(doc_id=i, length=1 + i % 9) for i in range(400)])
    out = packing.pack(pieces, 10, group_pieces=50).groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 10 for r in out) and sum(r[1] for r in out) == sum(1 + i % 9 for i in range(400))
