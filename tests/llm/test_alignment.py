from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from framewright.llm import alignment
from framewright.llm.registry import PIECES, tokenizer_file

SCHEMA = "doc_id long, text string, rid int, pair string, times int"
TEXTS = [
    "The quick brown fox", " leading", "  two  spaces   inside ", "tab\tand\nlines\n\n next", "naïve café 漢字 🙂 é", "a▁b", "▁", "<|endoftext|> <0x0A> </s>",
    None, "", " ", "\n", "word", "word", "don't we'll 1234567 3.14", "x" * 400, "the the the the", "\x00ctrl\x1c \x1c x", "　 wide   no-break", "end ",
    "The quick brown fox " * 200, "\r\n\r\n a", "ﬁ ligature Ａ", "ab  cd",
]


@pytest.fixture(scope="module")
def paths():
    return tokenizer_file(), tokenizer_file(PIECES)


def tokens(paths, text):
    """Ids and byte strings of both tokenizers over the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(printable)))}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in ids_b]
    return ids_a, raw_a, ids_b, raw_b


def plain(paths, texts):
    """Token by token, from the ends of tokens."""
    docs, counts = [], Counter()
    for text in texts:
        found = tokens(paths, text) if text else ([], [], [], [])
        want = (" " + (text or "")).encode()
        if b"".join(found[1]) != want or b"".join(found[3]) != want:
            docs.append(None)
            continue
        spans = []
        for raw in (found[1], found[3]):
            ends = np.cumsum([len(x) for x in raw]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(i, j) for i, x in zip(found[0], spans[0]) for j, y in zip(found[2], spans[1]) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            inside = [",".join(str(i) for i, (s, e) in zip(ids, sp) if lo <= s and e <= hi) for ids, sp in zip(found[::2], spans)]
            groups.append("|".join(inside))
        docs.append((len(found[0]), len(found[2]), links, groups))
        counts.update(links)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = d
        best, total = sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_against_plain_reading(spark, paths):
    docs = spark.createDataFrame([(k, t, 1, "clash", 2) for k, t in enumerate(TEXTS)] + [(0, "again", 1, "x", 2), (None, "null id", 1, "x", 2)], SCHEMA)
    got = alignment.align_documents(docs.repartition(3), *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(paths, [*TEXTS, "again", "null id"])
    ids = [*range(len(TEXTS)), 0, None]
    assert sorted((str(r[0]), tuple(r[1:])) for r in got.collect()) == sorted((str(i), w) for i, w in zip(ids, want))
    assert {w for w in want if not w[0]} and sum(1 for w in want if not w[0]) >= 4


def test_links_between_vocabularies(spark, paths):
    docs = spark.createDataFrame([(1, "the the cat"), (2, None)], "doc_id long, text string")
    got = {(r.a_id, r.b_id): (r.links, r.best) for r in alignment.id_links(docs, *paths).collect()}
    a, _, b, _ = tokens(paths, "the the cat")
    assert got[a[0], b[0]] == (2, True) and sum(n for n, _ in got.values()) == 3


def test_owners_and_overlaps():
    a, b = alignment.owners(np.array([2, 3, 1])), alignment.owners(np.array([1, 1, 3, 1]))
    starts, groups = alignment.overlaps(a, b)
    assert a.tolist() == [0, 0, 1, 1, 1, 2] and starts.tolist() == [0, 1, 2, 5] and groups.tolist() == [0, 2, 5]
    assert [x.tolist() for x in alignment.overlaps(a[:0], b[:0])] == [[], []]


def test_a_small_cache_changes_nothing(paths):
    units = [f"word{k % 7} {k}" for k in range(50)]
    small, large = alignment.Aligner(*paths, kept=3), alignment.Aligner(*paths)
    for k in [*range(0, 50, 5), 0, 20, 45]:
        assert small.aligned(units[k : k + 5]) == large.aligned(units[k : k + 5])
        assert small.aligned(units[k : k + 9]) == large.aligned(units[k : k + 9])
    assert len(small.known) + len(small.older) <= 6


def test_empty_table(spark, paths):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), *paths).collect() == []
