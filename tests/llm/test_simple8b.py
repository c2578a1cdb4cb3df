from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from framewright.llm import simple8b
from framewright.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, part string"


def test_round_trip_of_words():
    rng = random.Random(3)
    for bits in (1, 2, 7, 15, 16, 17, 31, 32, 59, 60, 61, 64):
        for n in (1, 2, 59, 60, 61, 500):
            ids = [rng.getrandbits(rng.randint(1, bits)) for _ in range(n)]
            ends = sorted({*rng.sample(range(1, n + 1), min(n, 4)), n})
            words, counts = simple8b.encode(np.array(ids, "u8"), np.array(ends))
            assert simple8b.decode(words).tolist() == ids
            at = np.concatenate([[0], np.cumsum(counts)])
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                assert simple8b.decode(words[at[k] : at[k + 1]]).tolist() == ids[a:b]


def test_escaped_ids_that_look_like_escapes():
    ids = [1 << 60, 5, (1 << 64) - 1, 1 << 63, 0, 3, 1 << 61]
    words, _ = simple8b.encode(np.array(ids, "u8"), np.array([len(ids)]))
    assert simple8b.decode(words).tolist() == ids


def test_many_small_ids_share_a_word():
    words, _ = simple8b.encode(np.ones(120, "u8"), np.array([120]))
    assert len(words) == 2
    assert len(simple8b.encode(np.zeros(60, "u8"), np.array([60]))[0]) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_files_against_a_plain_reading(spark, tmp_path, parts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    rows = [(i * 3, f"text {i} of some " * (i % 7), "clash") for i in range(60)]
    rows += [(500, None, None), (501, "long one " * 4000, None), (502, "<|endoftext|> x", None), (0, "again", None)]
    docs = spark.createDataFrame(rows[::-1], SCHEMA)
    simple8b.write_files(docs, str(tmp_path / "f"), tokenizer_file(), parts=parts, block_ids=200)
    out = simple8b.read_files(spark, str(tmp_path / "f")).collect()
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in rows}
    at = 0
    for r, doc in zip(sorted(out, key=lambda r: r.start), sorted(d for d, _, _ in rows), strict=True):
        assert (r.doc_id, r.start) == (doc, at)
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in ids.items() if d == doc}
        at += r.n_tokens
    assert simple8b.read_document(spark, str(tmp_path / "f"), 501) == ids[501, rows[61][1]]


def test_empty_table(spark, tmp_path):
    simple8b.write_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "f"), tokenizer_file())
    assert simple8b.read_files(spark, str(tmp_path / "f")).collect() == []


def test_slices_of_documents_are_coded_as_the_whole():
    ids, lengths = np.arange(5000, dtype="<u4") * 7919 % 50_000, [1, 0, 700, 3, 2500, 0, 1795, 1]
    words, many = simple8b.encode(ids, np.cumsum(lengths))
    parts = list(simple8b.encoded_slices(ids, np.cumsum(lengths), most=600))
    assert len(parts) > 2 and np.array_equal(np.concatenate([m for _, m in parts]), many)
    assert np.array_equal(np.concatenate([w for w, _ in parts]), words) and np.array_equal(simple8b.decode(words), ids)
