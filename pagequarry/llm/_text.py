"""Vectorised text primitives on Arrow buffers, shared by the operators of this subpackage.

A *word* is a maximal run of bytes that are ASCII letters, ASCII digits or not ASCII, in the
lower-cased UTF-8 text; every other byte separates words.  Words are carried as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 17
WORD_RE = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[128:] = True
_POW = np.random.default_rng(20240229).integers(1, 2**63, size=1 << 12, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_string_array(col) -> pa.Array:
    """One contiguous Arrow string array; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a string array without nulls."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(arr: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Consecutive slices of about ``size`` bytes (one longer text makes its own slice), so that
    the working memory does not depend on the rows in an Arrow batch."""
    _, offs = buffers(arr)
    at, n = 0, len(arr)
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, arr.slice(at, to - at)
        at = to


def word_hashes(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each text's first word (len(arr) + 1)."""
    if lower:
        arr = pc.utf8_lower(arr)
    data, offs = buffers(arr)
    p = np.flatnonzero(_IS_WORD[data])
    if not len(p):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    first = np.empty(len(p), bool)
    first[0] = True
    np.not_equal(p[1:], p[:-1] + 1, out=first[1:])
    cut = np.searchsorted(p, offs[:-1])
    first[cut[cut < len(p)]] = True
    starts = np.flatnonzero(first)
    lens = np.diff(starts, append=len(p))
    place = np.arange(len(p)) - np.repeat(starts, lens)
    h = (data[p].astype(np.uint64) + np.uint64(1)) * (_POW[place & 4095] + (place >> 12).astype(np.uint64))
    words = mix64(np.add.reduceat(h, starts))
    return words, np.searchsorted(p[starts], offs)


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for single words, in order; each must hold exactly one word."""
    h, offs = word_hashes(pa.array(words, pa.string()))
    if len(h) != len(words) or not (np.diff(offs) == 1).all():
        raise ValueError("each text must hold exactly one word")
    return h
