"""Vectorised word and window hashes over whole batches of UTF-8 texts.

Words are hashed by mixing eight bytes at a time (long ones by BLAKE2b). A polynomial hash modulo 2**64 with an odd base
gives the hash of any range of words or bytes from two prefix sums, as odd bases have inverses; ranges are moved to a
common power and mixed. Range hashes only choose what is compared: texts can be made whose ranges agree for every base.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
U64 = np.uint64
#: Bytes that separate words: white space alone, or all but ASCII letters, digits and what is not ASCII.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse, modulo 2**64; kept for the next call."""
    key = (int(base), inverse)
    if len(_POWERS.get(key, ())) < n:
        b = pow(int(base), -1, 1 << 64) if inverse else int(base)
        out = np.full(max(n, 1 << 16), U64(b))
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[key][:n]


def prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(U64) * powers(base, len(values)), out=out[1:])
    return out


def ranges(sums: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of the ranges [low, high), alike wherever they lie."""
    with np.errstate(over="ignore"):
        h = (sums[high] - sums[low]) * powers(base, len(sums), True)[low]
        return mix(h + (high - low).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes up to which a word is hashed by mixing.
SHORT = 64


def hash_words(data: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges."""
    size = high - low
    # Eight bytes from every place on, unaligned.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + BASES[seed])
        todo = np.flatnonzero((size > 0) & (size <= SHORT))
        at = 0
        while len(todo):
            left = np.minimum(size[todo] - at, 8).astype(U64)
            block = eight[low[todo] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - left * U64(8)))
            out[todo] = mix((out[todo] ^ block) * BASES[1 - seed] + U64(at + 1))
            at += 8
            todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[low[i] : high[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Words:
    """The words of texts that lie one after another in data; ends: where each text ends.

    low, high: each word's bytes; first: the number of words before each text (one more than texts); hash: per base.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACES, fold: bool = False, bases: int = 1) -> None:
        if fold:
            data = LOWER[data]
        self.data = data
        word = ~separators[data]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        before[starts[starts < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        after[ends[ends > 0] - 1] = False
        self.low = np.flatnonzero(word & ~before)
        self.high = np.flatnonzero(word & ~after) + 1
        self.first = np.concatenate([np.searchsorted(self.low, starts), [len(self.low)]]).astype(np.int64)
        self.hash = [hash_words(data, self.low, self.high, k) for k in range(bases)]

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each word starts (and the end)."""
        size = self.high - self.low + 1
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(int(begin[-1])) + np.repeat(self.low - begin[:-1], size)
        out = np.append(self.data, np.uint8(32))[at]
        out[begin[1:] - 1] = 32
        return out.tobytes(), begin
