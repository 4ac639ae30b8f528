"""Token ids of whole texts by a public tokenizer, with the ids of words already seen taken from a bounded table.

Plain text, whose letters, digits and spaces are the same in every Unicode version, is cut to the tokenizer's pre-tokens
by one pattern. Other text is cut at spaces between two characters that are not white space, where a new pre-token of
both tokenizers always begins, and the parts are joined. Only words not met before reach the tokenizer's model.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

GENERATION = 300_000  # entries of the younger half of the table, about 55 MB
SLICE = 1 << 18  # characters looked at at once
SPLIT = re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile("[\x00-ɏ]*")  # code points whose letter class and lower case no Unicode version changed
SPECIAL = "<|"  # how special tokens begin


def _class(kind: str) -> str:
    """Plain characters of a Unicode category, and what their lower case may be, for use in a pattern's brackets."""
    chars = {x for c in range(0x250) for x in chr(c) + chr(c).lower()}
    return "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == kind)


LETTERS, NUMBERS, SPACES = _class("L"), _class("N"), "\t-\r \x85\xa0"
BYTE_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
LOWER_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of words, as bytes. Words that are used move from the older half to this one; the older half goes when this is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        known = self.old.get(word)
        if known is None:
            known = self.encode(word)
        if len(self) > GENERATION:
            self.old = self.copy()
            self.clear()
        self[word] = known
        return known


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. ``lowered``: the tokenizer lower-cases and drops white space.

    The tables are bounded, and frequent words stay in them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.lowered = self.tokenizer.normalizer is not None
        self.find = LOWER_WORDS.findall if self.lowered else BYTE_WORDS.findall
        self.letters = byte_letters()
        self.words = Words(self._word)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null is empty. Long texts go through in slices cut between words."""
        if not text:
            return b""
        if len(text) <= SLICE:
            return self._slice(text)
        return b"".join(map(self._slice, slices(text)))

    def _slice(self, text: str) -> bytes:
        if SPECIAL not in text and (text.isascii() or PLAIN.fullmatch(text)):
            return self._plain(text)
        first, *rest = SPLIT.split(text)
        return b"".join(map(self._part, [first, *rest] if self.lowered else [first, *[" " + u for u in rest]]))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text.lower() if self.lowered else text)))

    def _part(self, unit: str) -> bytes:
        if SPECIAL in unit or not (unit.isascii() or PLAIN.fullmatch(unit)):
            return as_bytes(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        return self._plain(unit)

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        spelled = word.replace(" ", self.letters[32]) if plain else word.encode().decode("latin1").translate(self.letters)
        return as_bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])


def as_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def slices(text: str) -> Iterator[str]:
    """A long text cut in front of spaces that stand between words; a run without such a space stays whole.

    The space goes with what follows, as in the uncut text.
    """
    at = 0
    while len(text) - at > SLICE:
        cut = SPLIT.search(text, at + SLICE)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
