"""Splitting text into the pieces that byte-level tokenizers merge on their own."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

#: Letters and digits below U+0250 and the white space there, as Unicode has them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t-\r \x85\xa0"


#: Fixed value: the pattern of byte-level tokenizers that ``splitter`` knows a faster form of.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str):
    """A function text -> list of pieces, the matches of ``pattern``.

    Texts below U+0250 are split by ``KNOWN`` with its classes spelled out and
    letters, the most frequent, first: no other branch starts with one, and
    none gives back what it took.
    """
    import regex

    general = regex.compile(pattern).findall
    if pattern != KNOWN:
        return general
    other, blank = f"[^{BLANKS}{LETTERS}{DIGITS}]", f"[{BLANKS}]"
    narrow = re.compile(f" [{LETTERS}]++|[{LETTERS}]++| ?[{DIGITS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?{other}++|{blank}+(?![^{BLANKS}])|{blank}+").findall
    beyond = re.compile("[^\x00-ɏ]").search
    return lambda text: narrow(text) if text.isascii() or not beyond(text) else general(text)


class Remembered:
    """Entries of pieces, of which the latest ``room`` to ``2 * room`` are remembered.

    ``learn`` gives the entries of new pieces, in order. When ``room`` entries are
    new the older ones are forgotten, but for those that are asked for again.
    """

    def __init__(self, split: Callable, learn: Callable, room: int):
        self.split, self.learn, self.room, self.young, self.old = split, learn, room, {}, {}

    def _add(self, wanted: set[str]) -> None:
        young, old, unknown = self.young, self.old, []
        for x in wanted:
            if (entry := old.get(x)) is not None:
                young[x] = entry
            else:
                unknown.append(x)
        young.update(zip(unknown, self.learn(unknown), strict=True))

    def entries(self, texts: list[str]) -> list[list]:
        """For each text, the entries of its pieces in order."""
        pieces = list(map(self.split, texts))
        if new := set().union(*pieces).difference(self.young):
            if len(self.young) + len(new) > self.room:
                self.old, self.young, new = self.young, {}, set().union(*pieces)
            self._add(new)
        known = self.young.__getitem__
        return [list(map(known, x)) for x in pieces]


@contextmanager
def no_cycles():
    """No search for cycles meanwhile: many entries are made, none in a cycle, and each search would go through all."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def in_lots(texts: list[str], rows: int = 1000, chars: int = 4_000_000):
    """Consecutive lists of at most ``rows`` texts, and of about ``chars`` characters if there is more than one in it."""
    lot, size = [], 0
    for x in texts:
        if lot and (len(lot) >= rows or size + len(x) > chars):
            yield lot
            lot, size = [], 0
        lot.append(x)
        size += len(x)
    if lot:
        yield lot
