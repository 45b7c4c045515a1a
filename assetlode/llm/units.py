"""Texts cut at single spaces, so that what is known of a piece needs no second look.

The split pattern of the byte-level vocabularies always starts a new piece at a
space that stands between two other characters which aren't white space. The
pieces between such spaces are therefore independent of each other, and a table
from piece to result, kept between batches, answers for most of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)


class TwoAges(dict):
    """A bounded table: what was not asked for since the last turn-over is forgotten. fill gives a missing value.

    Texts longer than longest are never kept as keys, so these take up 2 * most * longest characters at most.
    """

    def __init__(self, fill: Callable[[Any], Any], most: int, longest: int | None = None) -> None:
        super().__init__()
        self.fill, self.most, self.longest, self.old = fill, most, longest, {}

    def __missing__(self, key: Any) -> Any:
        if self.longest and len(key) > self.longest:
            return self.fill(key)
        found = self.old.get(key, self)
        if found is self:
            found = self.fill(key)
        if len(self) < self.most:
            self[key] = found
        else:
            self.keep(key, found)
        return found

    def keep(self, key: Any, value: Any) -> None:
        if self.longest and len(key) > self.longest:
            return
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def open_ended(piece: str) -> bool:
    """Whether the piece doesn't stand alone: it is empty, or has white space at an end."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def cut(text: str) -> tuple[str, list[str]]:
    """The part before the first space and the parts after each space, the space left out."""
    first, *rest = text.split(" ")
    return first, rest


def words_of(piece: str) -> list[str]:
    """Matches of the split pattern in a piece and the space before it."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1:] in ",.!?;:" and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return PATTERN.findall(" " + piece)
