"""Texts cut into units that a byte-level BPE encodes independently of each other.

The pre-tokenizer's pattern takes white space only at the front of a piece, so
it always cuts before a space that follows a character other than white space.
What lies between two such places (a word, its punctuation and line ends) is a
unit; its ids do not depend on its neighbours.  Units repeat, so each Python
worker keeps a bounded number of them with whatever it has worked out.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the published pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LATIN_END = "\u0250"
#: White space, as ``\\s`` has it for strings, before a space.
_BLANK_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
latin_word = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
KEPT_UNITS = 400_000
LONGEST_KEPT = 64
_space_after_space = re.compile(r"\s ")
_cut = re.compile(r"(?<=\S) ")


class UnitCache(dict):
    """unit -> bytes.  Holds two generations of at most ``most`` units; long units are never kept."""

    def __init__(self, work_out: Callable[[str], bytes], most: int = KEPT_UNITS):
        super().__init__()
        self.work_out, self.most, self.older = work_out, most, {}

    def __missing__(self, unit: str) -> bytes:
        value = self.older.get(unit)
        if value is None:
            value = self.work_out(unit)
            if len(unit) > LONGEST_KEPT:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[unit] = value
        return value


def units(text: str) -> list[str]:
    """The text's units in order, each without the space it begins with, but for the first.

    Joined with spaces they give the text again.
    """
    return _cut.split(text) if _space_after_space.search(text) else text.split(" ")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class Encoder:
    """Texts to ids of a byte-level tokenizers file, as little-endian unsigned 32-bit integers.

    Units of Latin letters, marks and digits are cut by the published pattern
    and go to the library's model directly; any other unit goes to the library
    whole, so scripts and special strings are left to it.
    """

    def __init__(self, tokenizer_path: str, kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        pieces, tokens, bytes_as = regex.compile(PATTERN).findall, tokenizer.model.tokenize, byte_letters()
        letters = {c: "".join(bytes_as[b] for b in chr(c).encode()) for c in range(ord(LATIN_END))}
        space, stops = letters[ord(" ")], {s: whole_ids(tokens, letters, s) for s in ".,;:!?"}

        def later_ids(unit: str) -> bytes:
            if unit.isalpha() and (unit.isascii() or max(unit) < LATIN_END):
                found = tokens(space + (unit if unit.isascii() else unit.translate(letters)))
                return array("I", [t.id for t in found]).tobytes()
            if unit[-1:] in stops and unit[:-1].isalpha() and max(unit) < LATIN_END:
                return later[unit[:-1]] + stops[unit[-1]]
            return ids(" " + unit)

        def ids(unit: str) -> bytes:
            if max(unit, default=LATIN_END) >= LATIN_END or any(s in unit for s in special):
                return array("I", tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
            cut = pieces(unit)
            if len(cut) == 1:
                return whole_ids(tokens, letters, unit)
            return b"".join([later[p[1:]] if p[0] == " " else first[p] for p in cut])

        first = self.first = UnitCache(ids, kept)
        later = self.later = UnitCache(later_ids, kept)

    def __call__(self, text: str) -> bytes:
        head, *rest = units(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def batches(self, texts: pa.StringArray, most_bytes: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts, each with the end id 0, and their ends in the ids; in runs of about so many bytes of text."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
        cuts = np.flatnonzero(np.diff(size // most_bytes)) + 1 if len(size) else []
        for a, b in itertools.pairwise([0, *cuts, len(texts)]):
            if a < b:
                yield self._run(texts.slice(a, b - a))

    def _run(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The run's units are told apart by Arrow, so that each distinct one is looked up once."""
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype("i8")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _BLANK_SPACE).to_numpy(zero_copy_only=False))
        known = list(map(self.later.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        heads = [self.first[u] for u in pc.list_element(cut, 0).to_pylist()]
        for k in odd.tolist():  # cut elsewhere: the whole text stands in its head's place, and nothing after it
            heads[k] = self(texts[k].as_py())
        table = [*known, *heads, bytes(4), b""]
        code[at[:-1]] = len(known) + np.arange(len(heads))
        for k in odd.tolist():
            code[at[k] + 1 : at[k + 1]] = len(table) - 1
        code = np.insert(code, at[1:], len(table) - 2)
        length = np.array([len(x) for x in table]) // 4
        many = length[code]
        ends = np.cumsum(many)
        from_ = np.repeat((np.cumsum(length) - length)[code] - (ends - many), many) + np.arange(ends[-1])
        return np.frombuffer(b"".join(table), "<u4")[from_], ends[at[1:] + np.arange(len(heads))]


def whole_ids(tokens: Callable, letters: dict[int, str], piece: str) -> bytes:
    """Ids of one pre-token."""
    return array("I", [t.id for t in tokens(piece.translate(letters))]).tobytes()


@functools.lru_cache(2)
def encoder(tokenizer_path: str, kept: int = KEPT_UNITS) -> Encoder:
    """The worker's encoder of this file."""
    return Encoder(tokenizer_path, kept)
