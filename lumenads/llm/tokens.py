"""Token ids of whole texts by a public tokenizer file.

A text is cut where the tokenizer's own pattern always cuts (before white space
and after a run of plain letters), and the ids of each distinct cut are kept,
since words repeat. The ids equal those of the library on the whole text; texts
with white space other than space and line feed, or with special tokens, go
through the library whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CUTS = re.compile(
    rf"[ \n]*[{LETTERS}]+(?=[\x20-\x40\x5b-\x60\x7b-\x7e\n]|\Z)|[ \n]*[^ \n]+|[ \n]+"
)
PLAIN_WORD = re.compile(rf"([ \n]?)([{LETTERS}]+)\Z")
UNUSUAL_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
KEPT_CUTS = 300_000

_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A file name of the public tokenizers, or any path."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def encoder(name_or_path: str) -> "Encoder":
    """One encoder per file and Python worker."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = Encoder(name_or_path)
    return _ENCODERS[name_or_path]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder(dict):
    """Cut -> ids as little-endian unsigned 32-bit integers. At most two
    generations of ``KEPT_CUTS`` cuts are kept, so memory is bounded."""

    def __init__(self, name_or_path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name_or_path))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lower = self.library.normalizer is not None
        self.bytes = _byte_letters()
        self.older: dict[str, bytes] = {}
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, text: str) -> bytes:
        shown = text.encode().decode("latin-1").translate(self.bytes)
        return packed([t.id for t in self.library.model.tokenize(shown)])

    def of_cut(self, cut: str) -> bytes:
        word = PLAIN_WORD.match(cut)
        if word is None:
            return self._whole(cut)
        if self.lower:
            return self._word(word[2].lower())
        if word[1] == "\n":
            return self.line_feed + self._word(word[2])
        return self._word(cut)

    def __missing__(self, cut: str) -> bytes:
        ids = self.older.get(cut)
        if ids is None:
            ids = self.of_cut(cut)
        if len(self) >= KEPT_CUTS:
            self.older = dict(self)
            self.clear()
        self[cut] = ids
        return ids

    def may_cut(self, text: str) -> bool:
        """Whether the ids of the cuts are those of the text."""
        if UNUSUAL_SPACE.search(text) or any(s in text for s in self.specials):
            return False
        return not self.lower or text.isascii() or unicodedata.is_normalized("NFC", text)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text; a null text is an empty one."""
        if not text:
            return b""
        if not self.may_cut(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, CUTS.findall(text)))


class Counter(dict):
    """Numbers of ids by several tokenizers at once: cut -> counts, packed in one integer."""

    BITS = 40

    def __init__(self, names: tuple[str, ...]):
        super().__init__()
        self.encoders = [Encoder(n) for n in names]

    def __missing__(self, cut: str) -> int:
        if len(self) >= 2 * KEPT_CUTS:
            self.clear()
        self[cut] = value = sum((len(e.of_cut(cut)) // 4) << (self.BITS * i) for i, e in enumerate(self.encoders))
        return value

    def counts(self, text: str | None) -> list[int]:
        if not text:
            return [0] * len(self.encoders)
        if not all(e.may_cut(text) for e in self.encoders):
            return [len(e.ids(text)) // 4 for e in self.encoders]
        total = sum(map(self.__getitem__, CUTS.findall(text)))
        return [(total >> (self.BITS * i)) & ((1 << self.BITS) - 1) for i in range(len(self.encoders))]


_COUNTERS: dict[tuple[str, ...], Counter] = {}


def counter(names: tuple[str, ...]) -> Counter:
    """One counter per set of files and Python worker."""
    if names not in _COUNTERS:
        _COUNTERS[names] = Counter(names)
    return _COUNTERS[names]
