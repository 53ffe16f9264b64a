"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import utf8_slices

U = np.uint64
#: Bytes of texts that are hashed at a time: about ten arrays of eight bytes for each are held meanwhile.
SLICE = 1 << 18
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit words, each on its own (the finaliser of the SplitMix generator)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_PLACES = splitmix(np.arange(1, 4097, dtype=U)) | U(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the first word of each text (with the end as last entry).

    A-Z are lower-cased; words are runs of bytes other than white space, and never reach over a text's end.
    """
    data = _LOWER[data]
    full = ~_SPACES[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = full[heads]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(full)
    word = np.cumsum(first[at]) - 1
    place = at - starts[word]
    factor = _PLACES[place] if place.max(initial=0) < len(_PLACES) else splitmix(place.astype(U) + U(1)) | U(1)
    with np.errstate(over="ignore"):
        head = np.searchsorted(at, starts)
        sums = np.add.reduceat((data[at].astype(U) + U(1)) * factor, head)
    return splitmix(sums), np.searchsorted(starts, offsets)


def sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) for each text: its k-word shingles, or the whole sequence as one if it has fewer words."""
    for base, data, offsets in utf8_slices(column, SLICE):
        words, upto = word_hashes(data, offsets)
        with np.errstate(over="ignore"):
            acc = splitmix(words[: max(0, len(words) - k + 1)] ^ U(k))
            for j in range(1, k):
                acc = splitmix(acc * U(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
            for i in range(len(offsets) - 1):
                a, b = upto[i], upto[i + 1]
                if b - a >= k:
                    yield base + i, np.unique(acc[a : b - k + 1])
                elif b > a:
                    one = splitmix(words[a : a + 1] ^ U(b - a))
                    for j in range(a + 1, b):
                        one = splitmix(one * U(0xD6E8FEB86659FD93) + words[j : j + 1])
                    yield base + i, one
                else:
                    yield base + i, np.zeros(0, U)
