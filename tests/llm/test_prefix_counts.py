from __future__ import annotations

import random

import numpy as np
import pytest

from framewright.llm import prefix_counts
from framewright.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, n_tokens string"
ODD = [
    "", " ", "   ", "it's", "we'll've", " 's", "\n's", "a  b", "a   b", "a\n\n\nb", "a\n b", "\n\n  x 'd", "a'", "x'll",
    "<|endoftext|>", "a.<|endoftext|>", "a <|endoftext|>  <|endoftext|>b", "Ünïcödé ñandú", "日本語のテキスト", "12345 67",
    "é   x", "aaaaaaaaaaaaaaaaaaaaaaaa", "    def f(x):\n        return x", "🙂🙂 ok",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_every_prefix_as_the_library_counts_it(library):
    rng = random.Random(9)
    letters = ["a", "th", "e", "X", " ", "  ", "\n", "'s", "'", "l", "re", "7", ".", "!", "é", "\t", "<|endoftext|>"]
    made = ["".join(rng.choice(letters) for _ in range(25)) for _ in range(150)]
    count = prefix_counts.PrefixCounter(tokenizer_file())
    for text in ODD + made:
        changes = count(text)
        got = np.concatenate([[0], np.cumsum(np.frombuffer(changes, "i1"), dtype="i8")]).tolist()
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert got == want, text
        for budget in (0, 1, 5):
            assert prefix_counts.longest_prefix(changes, budget) == max(k for k, n in enumerate(want) if n <= budget)
        assert prefix_counts.tokens_of_prefix(changes, len(text) // 2) == want[len(text) // 2]


def test_a_long_text_without_spaces(library):
    text = "abcdefghij" * 3000
    n = np.frombuffer(prefix_counts.PrefixCounter(tokenizer_file())(text), "i1").sum(dtype="i8")
    assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_query_and_truncation(spark, library):
    rows = list(enumerate(ODD)) + [(90, None), (91, "many words here " * 2000), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = prefix_counts.count_tokens(docs, tokenizer_file()).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "").ids)) for d, t in rows]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in out], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 512) for r in out)
    for r in out:
        assert r.kept_tokens <= 512 and (r.over_limit or r.kept_tokens == r.n_tokens)
    stored = prefix_counts.prefix_changes(docs, tokenizer_file())
    cut = {r.doc_id: r for r in prefix_counts.truncated(docs, stored, 7).collect()}
    assert set(cut) == {d for d, _ in rows}
    assert len(library.encode(cut[91].kept_text).ids) <= 7 and cut[91].kept_chars == len(cut[91].kept_text)


def test_empty_table(spark):
    assert prefix_counts.count_tokens(spark.createDataFrame([], SCHEMA), tokenizer_file()).collect() == []
