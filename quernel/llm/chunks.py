"""Splitting texts where no token of a byte-level BPE pattern can cross.

In the patterns of byte-level BPE a plain space opens a match or belongs to a
run of white space, so a space after a character that is no white space always
starts a new match. The pieces between such places are encoded independently
and recur, so what they encode to can be kept.
"""

from __future__ import annotations

import ctypes
import inspect
import re
from collections.abc import Callable

import pyarrow as pa

#: Every character that Python or Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = tuple(dict.fromkeys([c + " " for c in WHITE] + [c + "\n" for c in WHITE] + ["\n" + c for c in WHITE]))
_ASCII_PAIRS, _WIDE_PAIRS = tuple(x for x in _PAIRS if x.isascii()), tuple(x for x in _PAIRS if not x.isascii())
_BOUND = re.compile(r"(?<=\S)(?= )")


def splits_plainly(text: str) -> bool:
    """Whether no white space stands beside a space or a line feed, so that each of them opens a chunk."""
    if len(text.split()) == 1 + text.count(" ") + text.count("\n"):
        return True  # as many words as single spaces and line feeds between them: no other white space at all
    return not (any(x in text for x in _ASCII_PAIRS) or not text.isascii() and any(x in text for x in _WIDE_PAIRS))


def chunks(text: str) -> list[str]:
    """The pieces of a text; joined they give the text again.

    Words with the space before them and single line feeds, or longer pieces
    where white space stands side by side.
    """
    if not splits_plainly(text):
        return _BOUND.split(text)
    out: list[str] = []
    for line in text.split("\n"):
        parts = line.split(" ")
        out.append(parts[0])
        out += [" " + x for x in parts[1:]]
        out.append("\n")
    del out[-1]
    return out


class Kept(dict):
    """A bounded memory of two generations: when it is full, what it holds becomes the older one, from which `again` fetches."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def room(self, more: int) -> None:
        if len(self) + more > self.most:
            self.older = dict(self)
            self.clear()

    def again(self, key):
        """What the older generation holds of a key, taken up again; None if nothing."""
        if (value := self.older.get(key)) is not None:
            self.room(1)
            self[key] = value
        return value


_held: dict = {}


def given_back() -> None:
    """Freed memory of this process, back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def held(key, make: Callable[[], object]):
    """What `make` made for a key in this process; what it held for another key goes first, and freed memory back to the system.

    Python workers outlive stages, so without this the memories of one
    operator would stay beside those of the next.
    """
    if key not in _held:
        _held.clear()
        given_back()
        _held[key] = make()
    return _held[key]


def alone_here() -> None:
    """Drop what operators hold in this process, for one that works with arrays."""
    if _held:
        _held.clear()
    given_back()


def alone(f: Callable) -> Callable:
    """f of one or two groups, each a table: what operators hold in this process goes before, and what f has freed goes back to the system behind it."""

    def whole(*tables):
        alone_here()
        try:
            return f(*tables)
        finally:
            given_back()

    # Spark counts the arguments
    return (lambda table: whole(table)) if len(inspect.signature(f).parameters) == 1 else (lambda table, other: whole(table, other))
