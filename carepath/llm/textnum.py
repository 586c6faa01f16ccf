"""Words and word shingles of many texts as numpy arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8
text. Each word becomes a 64-bit value (a polynomial over a random byte table),
each shingle a 64-bit value of its words, so a slice of texts is handled with a
fixed number of array operations and no per-word Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_POLY = _U(0x5851F42D4C957F2D)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=_U) * _GOLDEN)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


@dataclass
class Words:
    """Words of consecutive texts: owner text, 64-bit value, byte span in ``buf``."""

    buf: np.ndarray
    text_start: np.ndarray      # byte offset of each text in buf
    doc: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(texts: list[bytes], lower: bool = False) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(texts) else np.zeros(0, np.int64)
    solid = ~SPACE[buf]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(text_start, start, side="right") - 1
    if not len(start):
        return Words(buf, text_start, doc, np.zeros(0, _U), start, end)
    n = end - start
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(n.max()) + 1, _POLY, dtype=_U))
        value = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[buf[solid]] * power[inside], first)
        value = mix(value + n.astype(_U) * _GOLDEN)
    return Words(buf, text_start, doc, value, start, end)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and 64-bit value of every ``k``-word window inside one text."""
    n = len(w.value) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1:])
    with np.errstate(over="ignore"):
        value = np.full(len(at), _U(k) * _GOLDEN, dtype=_U)
        for j in range(k):
            value = mix(value + w.value[at + j] * _U(2 * j + 3))
    return at, value


def shingle_sets(texts: list[bytes], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text, ordered by (text, value).

    A text of fewer than ``k`` words (but one at least) has its whole word
    sequence as its one shingle; a text without words has none.
    """
    w = words(texts, lower)
    at, value = windows(w, k)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=len(texts)) if len(w.doc) else np.zeros(len(texts), np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), dtype=_U)
        first = np.searchsorted(w.doc, short)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                has = count[short] > j
                nxt = mix(whole + w.value[np.minimum(first + j, len(w.value) - 1)] * _U(2 * j + 3))
                whole = np.where(has, nxt, whole)
            whole = mix(whole + count[short].astype(_U))
        doc, value = np.concatenate((doc, short)), np.concatenate((value, whole))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
        doc, value = doc[new], value[new]
    return doc, value


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Start of each text's run in an array ordered by text; n + 1 entries."""
    return np.searchsorted(doc, np.arange(n + 1))
