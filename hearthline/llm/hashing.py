"""64-bit hashes of words, shingles and n-grams over many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_A, _B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _A
    x ^= x >> U64(27)
    x *= _B
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int, start: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(start + 1, start + n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_PLACE = stream(12, 4096) | U64(1)

#: Bytes that end a word: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word of ASCII digits and letters and of all other characters beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one space after each, and where each text starts (and the last ends)."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return data, starts


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the index of each text's first word (and the end).

    ends: by byte, whether it stands outside words; a space does.

    A word's hash is the sum of a random number per byte times an odd random number per place,
    mod 2^64, mixed with its length.
    """
    inside = ~ends[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first = np.flatnonzero(edge == 1)
    last = np.flatnonzero(edge == -1)  # every text ends with a space
    length = last - first
    if not len(first):
        return np.zeros(0, U64), first, np.zeros(len(starts), np.int64)
    at = np.flatnonzero(inside)
    place = at - np.repeat(first, length)
    if place.max() >= len(_PLACE):
        odd = stream(12, int(place.max()) + 1) | U64(1)
    else:
        odd = _PLACE
    with np.errstate(over="ignore"):
        value = _BYTE[LOWER[data[at]] if lower else data[at]] * odd[place]
        total = np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))
        hashed = mix(total + length.astype(U64))
    return hashed, first, np.searchsorted(first, starts)


def shingle_sets(raw: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; fewer words: all of them as one; none: empty."""
    data, starts = joined(raw)
    hashed, _, index = words(data, starts)
    weight = stream(13, size) | U64(1)
    out = []
    with np.errstate(over="ignore"):
        n = len(hashed) - size + 1
        rolled = np.zeros(max(n, 0), U64)
        for k in range(size):
            rolled += hashed[k : k + len(rolled)] * weight[k]
        rolled = mix(rolled)
        for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                one = (hashed[a:b] * weight[: b - a]).sum(dtype=U64) + U64(b - a)
                out.append(mix(np.array([one], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out
