"""Exact token counts at every prefix of a text, by dynamic programming.

Within one pre-token, a byte-level BPE encodes a prefix as the encoding of a
shorter prefix followed by one token; exactly one token ends the prefix such
that it and the token before it encode to just themselves.  So one pass over
the pre-token, looking at the tokens that end at each place, gives the count at
all its prefixes, in time linear in its length.  The counts of a text are those
of its units (see ``units``) one after another.  They are stored as one signed
byte per code point, the change of the count there; a running sum answers how
many tokens a prefix has, and how long a prefix fits a budget, without another
encoding.

Scale.  No shuffle: each text is counted where it is read, and its changes are
written, a byte a code point; every question is answered from that table.  A
worker keeps a bounded number of units.

Edge cases.  Null text counts as empty and has no tokens.  Special strings
inside a text are single tokens, as the library takes them by default.  Rows
that repeat a doc_id are counted each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.memory import frugal
from framewright.llm.text import text_of
from framewright.llm.units import LATIN_END, PATTERN, UnitCache, byte_letters, latin_word, units
from framewright.storage import materialize

LIMIT = 512
KEPT_PAIRS = 500_000
KEPT_STEMS = 100_000
STEM = 10

_NONE: dict[str, bool] = {}
_two_blanks = re.compile(r"\s\s").search


@functools.lru_cache(4096)
def _starts(j: int, longest: int) -> tuple[int, ...]:
    """Starts of the tokens that may end at ``j``, those of 2 to 5 letters first."""
    usual = [j - n for n in (3, 4, 2, 5, 1) if n <= j]
    return (*usual, *range(j - 6, max(-1, j - longest - 1), -1))


class PrefixCounter:
    """Changes of the token count along a text, one per code point."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = tokenizer.model
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.vocabulary = {t: i for t, i in tokenizer.get_vocab().items() if t not in special}
        self.longest = max(map(len, self.vocabulary))
        bytes_as = byte_letters()
        self.letters = {c: "".join(bytes_as[b] for b in chr(c).encode()) for c in range(ord(LATIN_END))}
        self.bytes_as = bytes_as
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.stems: dict[str, tuple[list[int], list[str]]] = {}
        self.first = UnitCache(self.changes)
        self.later = UnitCache(lambda unit: self.changes(" " + unit))

    def __call__(self, text: str) -> bytes:
        head, *rest = units(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def _follows(self, before: str, token: str) -> bool:
        """Whether the two tokens encode to themselves when written together."""
        if self.known_pairs >= KEPT_PAIRS:
            self.pairs, self.known_pairs = {}, 0
        known = [t.value for t in self.model.tokenize(before + token)] == [before, token]
        self.pairs.setdefault(before, {})[token] = known
        self.known_pairs += 1
        return known

    def counts(self, piece: str) -> list[int]:
        """Tokens of every prefix of one pre-token, by code points from 0."""
        if piece.isascii():
            word, ends = piece.translate(self.letters), None
        else:
            letters = [self.letters.get(ord(c)) or "".join(self.bytes_as[b] for b in c.encode()) for c in piece]
            word, ends = "".join(letters), [0, *accumulate(map(len, letters))]
        vocabulary, pairs, longest = self.vocabulary, self.pairs, self.longest
        stem = word[:STEM]
        if stem in self.stems:  # many words begin alike: the work up to there is kept
            count, last = (x.copy() for x in self.stems[stem])
        else:
            count, last = [0], [""]
        for j in range(len(count), len(word) + 1):
            # One start fits; the usual lengths come first.
            for i in _starts(j, longest):
                token = word[i:j]
                if token in vocabulary:
                    if i:
                        known = pairs.get(last[i], _NONE).get(token)
                        if known is False or known is None and not self._follows(last[i], token):
                            continue
                    count.append(count[i] + 1)
                    last.append(token)
                    break
            if j == STEM:
                if len(self.stems) >= KEPT_STEMS:
                    self.stems.clear()
                self.stems[stem] = count.copy(), last.copy()
        return count if ends is None else [count[e] for e in ends]

    def _plain(self, text: str) -> list[int]:
        """Tokens of every prefix of a text without special strings."""
        out, done, blank = [0], 0, ""
        for piece in self.pattern.findall(text):
            inside = self.counts(piece)
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # a contraction: its beginnings are cut elsewhere
                inside[1:-1] = [sum(self.counts(p)[-1] for p in self.pattern.findall(piece[:k])) for k in range(1, len(piece))]
            out += [done + n for n in inside[1:]]
            if blank and piece[0].isspace():  # a prefix that ends here has one run of white space
                out[-len(piece)] = done - self.counts(blank)[-1] + self.counts(blank + piece[0])[-1]
            blank = piece if piece.isspace() else ""
            done += inside[-1]
        return out

    def changes(self, text: str) -> bytes:
        """The change of the count at each code point, as signed bytes."""
        if latin_word(text):
            return changes_of(self.counts(text))
        found = list(self.special.finditer(text))
        if not found and "'" not in text and not _two_blanks(text):  # then its pieces don't touch each other
            pieces = self.pattern.findall(text)
            if len(pieces) > 1:
                return b"".join([self.later[p[1:]] if p[0] == " " else self.first[p] for p in pieces])
        out, done, at = [0], 0, 0
        for m in found:
            inside = self._plain(text[at : m.end() - 1])
            out += [done + n for n in inside[1:]]
            done += inside[m.start() - at] + 1
            out.append(done)
            at = m.end()
        out += [done + n for n in self._plain(text[at:])[1:]]
        return changes_of(out)


def changes_of(counts: list[int]) -> bytes:
    """Differences as signed bytes: one more code point adds one token, or lets a few at the end merge."""
    return array("b", map(sub, counts[1:], counts)).tobytes()


@functools.lru_cache(2)
def counter(tokenizer_path: str) -> PrefixCounter:
    """The worker's counter for this file."""
    return PrefixCounter(tokenizer_path)


def prefix_changes(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_bytes and changes (binary, one signed byte per code point)."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes_of = counter(tokenizer_path)
        for batch in batches:
            changes = pa.array([changes_of(t) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], changes], ["doc_id", "text_hash", "n_bytes", "changes"])

    chosen = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text_of(text)).alias("text_hash"),
        F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
        text_of(text).alias("text"),
    )
    return chosen.mapInArrow(count, "doc_id long, text_hash long, n_bytes long, changes binary")


def tokens_of_prefix(changes: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(changes, "i1")[:n_chars].sum(dtype="i8"))


def longest_prefix(changes: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(changes, "i1"), dtype="i8")])
    return int(np.flatnonzero(counts <= budget)[-1])


def answered(stored: DataFrame, budget: int = LIMIT) -> DataFrame:
    """``stored``, rows of ``prefix_changes``, with n_tokens, over_limit, kept_chars and kept_tokens, from the changes alone.

    kept_chars and kept_tokens: the longest prefix of at most ``budget`` tokens, in code points, and its tokens.
    """

    @frugal
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, chars, kept = [], [], []
            for changes in batch.column(3):
                counts = np.cumsum(np.frombuffer(changes.as_buffer(), "i1"), dtype="i8")
                n = int(counts[-1]) if len(counts) else 0
                fit = len(counts) if n <= budget else int(np.flatnonzero(counts <= budget)[-1]) + 1 if (counts <= budget).any() else 0
                total.append(n)
                chars.append(fit)
                kept.append(int(counts[fit - 1]) if fit else 0)
            columns = [pa.array(x, pa.int64()) for x in (total, chars, kept)]
            names = ["doc_id", "text_hash", "n_bytes", "n_tokens", "kept_chars", "kept_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names)

    schema = "doc_id long, text_hash long, n_bytes long, n_tokens long, kept_chars long, kept_tokens long"
    found = stored.select("doc_id", "text_hash", "n_bytes", "changes").mapInArrow(answer, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > budget)


def truncated(docs: DataFrame, stored: DataFrame, budget: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kept_chars, kept_text of every row: the longest prefix within ``budget`` tokens.  Nothing is encoded."""
    cuts = answered(stored, budget).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "kept_chars")
    cuts = cuts.dropDuplicates(["of", "hash"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    met = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("hash")))
    return met.select("doc_id", "kept_chars", F.substring("text", F.lit(1), F.col("kept_chars").cast("int")).alias("kept_text"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_chars, kept_tokens for every document.

    The changes are written once; counts and the longest prefix within the limit are read from them.
    """
    stored = materialize(prefix_changes(docs, tokenizer_path, text, doc_id), "prefix-changes")
    return answered(stored, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars", "kept_tokens")
