"""Words and sets of word shingles as 64-bit keys, computed for a whole text at once.

A word's key is a polynomial in a fixed odd base over fixed random values of its bytes (those of A-Z are
those of a-z), modulo 2**64, then mixed: the difference of two running sums over the text. A shingle's
key combines its words' keys, and a set's key hashes its sorted keys. Two different words, shingles or
sets share a key with a chance of about 2**-64 a pair; these are the only places where chance enters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
PIECE = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """A batch's texts as Python strings, of which only one need be held at a time."""
    return (t.as_py() for t in texts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    plain = np.arange(256, dtype=np.uint64)
    plain[65:91] += np.uint64(32)
    return mixed(plain * _FACTORS[0] + _FACTORS[1])


_VALUES = _byte_values()


class Powers:
    """Powers of the base and of its inverse, grown when a longer piece comes."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)
        self.upto(1 << 14)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = Powers()


def word_keys(text: str | bytes | None) -> np.ndarray:
    """The key of each word of the text, words being what ASCII white space separates."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    if len(data) <= PIECE:
        return _keys(data)
    blanks = np.flatnonzero(BLANK[data])
    parts, at = [], 0
    while at < len(data):  # cut at the last blank of a piece, or at the next one where a word is longer
        end = len(data)
        if end - at > PIECE:
            i = np.searchsorted(blanks, at + PIECE)
            end = int(blanks[i - 1]) + 1 if i and blanks[i - 1] >= at else int(blanks[i]) + 1 if i < len(blanks) else end
        parts.append(_keys(data[at:end]))
        at = end
    return np.concatenate(parts)


def _keys(data: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    blank = BLANK[data]
    bounds = np.concatenate([[0], np.flatnonzero(blank[1:] != blank[:-1]) + 1, [n]])
    begin, end = bounds[int(blank[0]) : -1 : 2], bounds[int(blank[0]) + 1 :: 2]
    up, down = _POWERS.upto(n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=running[1:])
    return mixed((running[end] - running[begin]) * down[begin] + (end - begin).astype(np.uint64))


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' keys, ascending; one key for the whole of a shorter text, none without words."""
    keys = word_keys(text)
    n = len(keys)
    if not n:
        return keys
    span = min(n, width)
    total = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        total = (total + keys[i : n - span + 1 + i]) * _FACTORS[i % 5] + np.uint64(i)
    return distinct(mixed(total))


def set_key(keys: np.ndarray) -> int:
    """Signed, to fit a long."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes()))))
