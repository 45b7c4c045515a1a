"""Token ids of whole texts by a tokenizer file of the `tokenizers` library."""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np

from assetlode.llm.units import PATTERN, TwoAges, cut, open_ended

#: Entries that a worker keeps: of pieces between spaces, and of other pieces of the split pattern, and the longest of them.
UNITS, WORDS, LONG = 600_000, 100_000, 64
#: Letters in every version of Unicode, so the library's split pattern keeps them together.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: What the split pattern parts from letters before it and keeps together.
_MARKS = ",.!?;:#*$%&|<>"
_SHARED: dict[tuple[str, bool], Encoder] = {}


def _shown() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _shown()


class Encoder:
    """Ids as the library gives them for the whole text, without special tokens.

    The library encodes each match of its split pattern by itself. What it
    gave for a piece is kept, so a piece seen before costs a look-up; every new
    piece goes through the library. A new word of letters goes straight to the library's
    model, as its normalizer and its split would leave it as it is.

    The library finds the strings of added tokens such as <|endoftext|> in a text before it splits the
    rest, and gives their ids for them even without add_special_tokens. With special_as_text those
    strings are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self._tokenizer.get_vocab_size()
        #: Strings that the library takes out of a text first.
        self._added = [] if special_as_text else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        split = self._tokenizer.pre_tokenizer
        #: Whether words can go to the model itself.
        self._direct = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and self._tokenizer.normalizer is None and self._plain(special_as_text)
        self._tokens = self._tokenizer.model.tokenize
        self._bytes = [pack("<I", i) for i in range(1 + max(self._tokenizer.get_vocab().values(), default=-1))]
        self._words = TwoAges(self._encode, WORDS, LONG)
        self._units = TwoAges(self._unit, UNITS, LONG)

    def _plain(self, special_as_text: bool) -> bool:
        """Whether no added token is left to be found inside words; without special_as_text texts that hold one don't come that far."""
        return not special_as_text or all(t.special for t in self._tokenizer.get_added_tokens_decoder().values())

    @classmethod
    def shared(cls, path: str, special_as_text: bool = False) -> Encoder:
        """One for each worker process and file, so what it learned serves the next task."""
        if (path, special_as_text) not in _SHARED:
            _SHARED[path, special_as_text] = cls(path, special_as_text)
        return _SHARED[path, special_as_text]

    def _encode(self, word: str) -> bytes:
        return pack(f"<{len(ids := self._tokenizer.encode(word, add_special_tokens=False).ids)}I", *ids)

    def _letters(self, letters: str) -> bytes:
        """Of letters and the space before them."""
        if not self._direct:
            return self._encode(" " + letters)
        if letters.isascii():
            shown = "Ġ" + letters
        elif _LETTERS.fullmatch(letters):
            shown = "Ġ" + letters.encode().decode("latin-1").translate(_SHOWN)
        else:
            return self._encode(" " + letters)
        return b"".join([self._bytes[t.id] for t in self._tokens(shown)])

    def _unit(self, piece: str) -> bytes | None:
        """Of a piece and the space before it; words after a space are known by the table of pieces."""
        if piece.isalpha():
            return self._letters(piece)
        bare = piece.rstrip(_MARKS)
        if bare.isalpha():
            return (self._units.get(bare) or self._letters(bare)) + self._words[piece[len(bare) :]]
        if open_ended(piece):
            return None
        first, *rest = PATTERN.findall(" " + piece)
        bare = first[1:]
        known = (self._units.get(bare) or self._letters(bare)) if first[0] == " " and bare.isalpha() else self._words[first]
        return known + b"".join(map(self._words.__getitem__, rest))

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, PATTERN.findall(text)))

    def raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(a in text for a in self._added):
            return self._encode(text)
        first, rest = cut(text)
        if rest and not open_ended(first):
            try:
                return self._split(first) + b"".join(map(self._units.__getitem__, rest))
            except TypeError:  # a piece that doesn't stand alone
                pass
        return self._split(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")
