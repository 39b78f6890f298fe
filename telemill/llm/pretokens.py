"""Cutting a text where the pre-tokenisation pattern always cuts it, so that pieces can be encoded once and kept."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space before further white space: only then may a pre-token hold a space that isn't its first character.
_RUN = re.compile(r" \s")


def spaced(text: str) -> list[str] | None:
    """The text in pieces, each but the first beginning with its only space; None where white space runs on.

    A space between a character and a non-space begins a pre-token, whatever stands around it, so that the pieces'
    pre-tokens are those of the text.
    """
    if _RUN.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Memo(dict):
    """Keeps what make() gives for a key; starts afresh at `most` entries, so that memory stays bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(Memo):
    """Keeps `most` entries and the `most` before them, so that what is asked for again and again is never made anew."""

    def __init__(self, make: Callable, most: int):
        super().__init__(make, most)
        self.old: dict = {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
