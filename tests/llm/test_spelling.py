from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from framewright.llm import spelling
from framewright.storage import materialize

SCHEMA = "doc_id long, text string, word string, n int, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(u, v):
    """By trying every edit of the shorter word, or of the first."""
    u, v = sorted((u, v), key=len)
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(rows, least_times=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_times}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


TEXTS = [
    (1, "receive recieve receive reciive RECEIVE receive receive receives receive " * 3),
    (2, "Étude Étude Étude étude étude étude etude etude etude × ÷ ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"),
    (2, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"),
    (None, "abcde abcde abcde abcdef abcdef abcdef bcdef bcdef bcdef"),
    (3, None), (4, ""), (5, "1234 ... 漢字 naïve naïve naïve naive naive naive naive naive naive"),
    (6, ("x" * 3000 + " ") * 3 + ("x" * 2999 + "y ") * 9),
    *[(k, "planet planets plane splendid planed") for k in range(100, 400)],
]


@pytest.mark.parametrize("most", [2, 64])
def test_against_brute_force(spark, most):
    """Blocks of more than two words are subdivided to the end; slips by the hash are among the 300 repeats."""
    docs = spark.createDataFrame([(d, t, "clash", 1, "k") for d, t in TEXTS], SCHEMA)
    assert rows_of(spelling.variants(docs, most=most)) == expected(TEXTS)


def test_crowded_block_loses_no_pair(spark):
    """Words that share a long prefix, and words that share a long suffix."""
    words = sorted({f"crowded{a}{b}" for a in "abcdefgh" for b in "abcdefgh"} | {f"{a}{b}endings" for a in "abcdefgh" for b in ("", *"abcdefgh")})
    table = materialize(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), "test-words")
    got = [(r.word, r.near) for r in spelling.near_words(table, most=4).collect()]
    assert sorted(got) == sorted((u, v) for u in words for v in words if u != v and one_edit(u, v))


@given(st.lists(st.text("ab", min_size=1, max_size=6), unique=True, max_size=12), st.integers(0, 3), st.integers(0, 3))
def test_a_block_takes_no_wrong_pair(words, a, b):
    m = max(map(len, words), default=0) - 1
    held = [(w, 1) for w in words if len(w) in (m, m + 1) and w[:a] == words[0][:a] and (not b or w[-b:] == words[0][-b:])]
    if a + b <= m:
        for u, _, v, _ in spelling.near_in_block(m, a, b, held):
            assert one_edit(u, v)


def test_chains_lead_to_one_root(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(33)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame([*chain, ("alone", "other")], "word string, form string")).collect()}
    assert got == {**{w: "w33" for w, _ in chain}, "alone": "other"}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
