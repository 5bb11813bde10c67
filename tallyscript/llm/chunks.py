"""Byte-level encoding by remembered chunks: natural text repeats its words, so most need no merge twice.

A single U+0020 between two characters that aren't white space always starts a pre-token of the split pattern,
whatever surrounds it. So a text without other spaces is cut there, and each chunk's ids are its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space by Unicode's property, which differs from Python's own class.
SPACE = r"[\t-\r \x85\xa0  -     　]"
_ODD = re.compile(rf"{SPACE} | {SPACE}|^ | $|[\x1c-\x1f]")


class Chunks:
    """Ids of words that follow a space, in the form that `many` gives for a list of them; two generations of
    at most `limit` words each are remembered, so frequent words stay."""

    def __init__(self, many: Callable[[list[str]], list], limit: int = 250_000) -> None:
        self.many, self.limit, self.new, self.old = many, limit, {}, {}

    def of(self, texts: list[str | None]) -> list[tuple[str, list] | None]:
        """For each text its first chunk and the forms of the rest; None for a text that must be encoded whole."""
        cut = [None if not t or _ODD.search(t) else t.split(" ") for t in texts]
        words: set[str] = set()
        for c in cut:
            if c:
                words.update(c[1:])
        if len(self.new) + len(words) > self.limit:
            self.old, self.new = self.new, {}
        here = self.new
        unknown = []
        for w in words.difference(here):
            known = self.old.get(w)
            if known is None:
                unknown.append(w)
            else:
                here[w] = known
        if unknown:
            here.update(zip(unknown, self.many(unknown), strict=True))
        return [c and (c[0], list(map(here.__getitem__, c[1:]))) for c in cut]
