"""Vectorised text over Arrow batches: words, word hashes and shingle hashes of many documents at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over its bytes, read off
prefix sums, so no Python loop touches words or documents.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        x = np.full(max(n, 1 << 19), _BASE if kind == "p" else _INVERSE, np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of documents of about `most` bytes; a longer document stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def documents(column, most: int = 1 << 19):
    """(first, last, bytes, offsets) for each range of documents of a batch."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each document's words begin among them."""
    inside = ~SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("p", len(data)), out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * _power("i", len(data) + 1)[starts])


def windows(words: np.ndarray, woff: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words inside a document, and the index of the run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _BASE + words[k : k + n]
    valid = np.zeros(n + width, bool)
    valid[:n] = True
    for k in range(1, width):  # a run may not pass the end of its document
        at = woff[1:] - k
        valid[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(valid[:n])
    return mix(total[at], width), at


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every shingle in text order, after lowering A-Z; a shorter text is one shingle, no word is none."""
    data = LOWER[data]
    starts, ends, woff = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    h, at = windows(words, woff, width)
    doc = np.searchsorted(woff, at, "right") - 1
    counts = np.diff(woff)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for d in short:
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[woff[d] : woff[d + 1]]:
                    total = total * _BASE + w
            extra.append(total)
        h = np.concatenate([h, mix(np.array(extra, np.uint64), 77) + counts[short].astype(np.uint64)])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes in ascending order, and where each document's begin."""
    h, doc = shingles(data, offsets, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def reduce_by(values: np.ndarray, bounds: np.ndarray, op=np.add) -> np.ndarray:
    """op over each slice of values; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out
