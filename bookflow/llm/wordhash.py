"""64-bit hashes of words and of runs of words, as numpy arrays over the bytes of a text."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20))
#: A random number for each byte, and one for each place in a word; a word's hash is the sum of their products.
_BYTE, _PLACE = _rng.integers(1, 1 << 63, 256, np.uint64), _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of two independent families of run hashes.
_FAMILIES = tuple((np.uint64(a), np.uint64(b)) for a, b in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of UTF-8 bytes, in order; the words are those of bytes.split()."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    times = _PLACE[place & 63]
    if length.max() > 64:
        times = times + (place >> 6).astype(np.uint64) * _FAR
    h = np.add.reduceat(_BYTE[data[at]] * times, first) + length.astype(np.uint64) * _FAR
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _pair(x: np.ndarray, y: np.ndarray, family: int) -> np.ndarray:
    a, b = _FAMILIES[family]
    z = x * a
    z += y * b
    z ^= z >> np.uint64(31)
    return z


def runs(one: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hash of each run of `length` items: a run is the pair of its halves, so runs twice as long come from those at hand."""
    n = len(one) - length + 1
    if n <= 0:
        return one[:0]
    if length == 1:
        return one
    half = length // 2
    left = runs(one, half, family)
    right = left if length % 2 == 0 else _pair(left[: len(one) - half], one[half:], family)
    return _pair(left[:n], right[half : half + n], family)


def sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """`take` (np.minimum or np.maximum) over each `width` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = take(out[:-have], out[have:])
        have *= 2
    return take(out[:n], out[width - have : width - have + n])


def anchors(base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `width` neighbouring hashes the least one, and a mask of the hashes that are the least of some such window.

    It depends on the window's own content alone, so equal windows have equal anchors wherever they are.
    """
    least = sliding(base, width, np.minimum)
    if not len(least):
        return least, np.zeros(len(base), bool)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return least, sliding(padded, width, np.maximum) == base
