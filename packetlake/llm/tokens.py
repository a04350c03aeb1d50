"""Units of texts by a public vocabulary's pattern, and token values of units with bounded per-worker caches.

The pattern's pieces never span a single space followed by other text except as that text's first character. So a text
without three white-space characters in a row, or two at its end, falls into units at its spaces, and a unit seen before
costs one look-up. Other texts are split by the pattern itself.
"""

import functools
import re

import numpy as np

#: Units and pieces kept in a worker's caches; longer ones than LONG characters are never kept.
CACHE, LONG = 700_000, 64
_WIDE = re.compile(r"\s{3}|\s{2}\Z")
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


@functools.cache
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    return pattern().findall(text)


#: Kinds of bytes that the pattern keeps apart: letters, digits, signs, blanks; beyond ASCII and apostrophes (0) it decides itself.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[_BLANK] = 4
_KIND[[0x27, *range(128, 256)]] = 0


def unit_starts(data: np.ndarray, offsets: np.ndarray):
    """Where the units of UTF-8 documents begin, which of them are single pieces of the pattern, and where each document's units begin.

    Units end before spaces, and where the kind of an ASCII byte changes. A document is split by the pattern itself where
    it may have wide white space: three blanks in a row, two at its end, or any blank beyond ASCII.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    kind, space = _KIND[data], data == 0x20
    blank = kind == 4
    odd = np.zeros(n, bool)
    odd[2:] = blank[2:] & blank[1:-1] & blank[:-2]
    high = np.flatnonzero(data >= 0xC2)
    lead, then = data[high], data[np.minimum(high + 1, n - 1)]
    maybe = ((lead == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((lead == 0xE1) & (then == 0x9A)) | ((lead == 0xE3) & (then == 0x80))
    odd[high[maybe | ((lead == 0xE2) & ((then == 0x80) | (then == 0x81)))]] = True
    full = offsets[1:] > offsets[:-1]
    last = offsets[1:][full] - 1
    odd[last] |= blank[last] & (last > 0) & blank[last - 1]  # two blanks over a document's edge only send it the slow way
    wide = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0
    first = space.copy()
    first[offsets[:-1][full]] = True
    region = np.flatnonzero(first)  # up to the next space
    size = np.diff(np.append(region, n))
    mixed = np.maximum.reduceat((kind == 0).astype(np.uint8), region) > 0
    cut = np.zeros(n, bool)
    cut[1:] = ((kind[1:] != kind[:-1]) & ~space[:-1]) | (blank[1:] & ~space[1:])
    begins = first | (cut & ~np.repeat(mixed, size))
    single = begins & ~np.repeat(mixed, size)
    for d in np.flatnonzero(wide):
        s, e = int(offsets[d]), int(offsets[d + 1])
        begins[s:e] = False
        size = np.array([len(p.encode()) for p in pieces(data[s:e].tobytes().decode())])
        at = s + np.cumsum(size) - size
        begins[at] = single[at] = True
    starts = np.flatnonzero(begins)
    return starts, single[starts], np.searchsorted(starts, offsets)


class Cache:
    """Values of units. encode: list of pieces -> {piece: value}; join: list of values -> value.

    whole: an optional faster way for units of clean text: list of units -> list of values.
    """

    def __init__(self, encode, join, whole=None):
        self.encode, self.join, self.whole = encode, join, whole
        self.plain: dict = {}
        self.spaced: dict = {}
        self.piece: dict = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its units in order; all that is new among them is encoded together."""
        split = []
        plain, spaced = set(), set()
        for t in texts:
            if _WIDE.search(t):
                a, b = pieces(t), ()
            else:
                b = t.split(" ")
                a = (b.pop(0),)
                if not a[0]:
                    a = ()
            split.append((a, b))
            plain.update(a)
            spaced.update(b)
        new = [plain.difference(self.plain), spaced.difference(self.spaced)]
        if len(self.plain) + len(self.spaced) + len(new[0]) + len(new[1]) > CACHE:
            self.plain.clear(), self.spaced.clear()
            new = [plain, spaced]
        if self.whole:
            easy = [u for u in new[1] if u and not u[-1].isspace() and not u[0].isspace()]
            self.spaced.update(zip(easy, self.whole([" " + u for u in easy])))
            new[1] = new[1].difference(easy)
        cut = [[(u, pieces(u if k == 0 else " " + u)) for u in n] for k, n in enumerate(new)]
        used = {p for c in cut for _, x in c for p in x}
        if len(self.piece) + len(used) > CACHE:
            self.piece.clear()
        todo = list(used.difference(self.piece))
        if todo:
            self.piece.update(self.encode(todo))
        for own, c in zip((self.plain, self.spaced), cut):
            own.update((u, self.piece[x[0]] if len(x) == 1 else self.join([self.piece[p] for p in x])) for u, x in c)
        one, two = self.plain, self.spaced
        out = [[one[u] for u in a] + [two[u] for u in b] for a, b in split]
        for own, fresh in ((self.plain, new[0]), (self.spaced, new[1]), (self.piece, todo)):
            for u in [u for u in fresh if len(u) > LONG]:
                own.pop(u, None)
        return out
