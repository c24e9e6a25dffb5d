"""Pre-tokens of whole texts, each distinct stretch of a text worked out once per worker.

The public pattern attaches one space to the word after it, so a text may be
cut at every single space that stands between two characters that are not
white space, and each stretch split by itself.  Texts with other white space
around their spaces are split whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import regex

#: Marks that the public pattern splits from the letters before them.
_AFTER = frozenset(".,;:!?")


class _Table(dict):
    """stretch -> value, computed on first use; ``None`` marks a stretch whose text has to be split whole."""

    def __init__(self, owner: PreTokens, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, stretch: str):
        owner = self.owner
        if owner.public and stretch.isalpha():  # most stretches are one word, maybe with a mark
            value = owner.fn(self.prefix + stretch)
        elif owner.public and len(stretch) > 1 and stretch[-1] in _AFTER and stretch[:-1].isalpha():
            value = owner.join([self[stretch[:-1]], owner.first[stretch[-1]]])
        elif not stretch or stretch[0].isspace() or stretch[-1].isspace():
            value = None
        else:
            value = owner.join([owner.piece(p) for p in owner.split(self.prefix + stretch)])
        if len(self) >= owner.memory:
            self.clear()
        self[stretch] = value
        return value


class PreTokens:
    """Values of the stretches of a text, in order.

    ``fn`` gives the value of a pre-token and ``join`` that of several;
    ``whole``, if given, serves the texts that cannot be cut.  ``memory``
    entries are remembered per worker; a full table is emptied and filled
    anew, so it bounds memory, not results.
    """

    def __init__(self, pattern: str, fn: Callable[[str], object], join: Callable[[list], object], whole: Callable[[str], object] | None = None, memory: int = 500_000):
        self.split, self.public = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        self.fn, self.join, self.memory = fn, join, memory
        self.whole = whole or (lambda text: join([fn(p) for p in self.split(text)]))
        self.first, self.later = _Table(self, ""), _Table(self, " ")

    def piece(self, piece: str):
        """The value of a pre-token, from the tables if it is a word."""
        if self.public and piece[:1] == " " and piece[1:].isalpha():
            return self.later[piece[1:]]
        return self.first[piece] if self.public and piece.isalpha() else self.fn(piece)

    def __call__(self, text: str) -> list:
        if not text:
            return []
        head, *rest = text.split(" ")
        values = [self.first[head], *map(self.later.__getitem__, rest)]
        return [self.whole(text)] if None in values else values
