"""Hashes of words and substrings, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random number for each byte value, and the odd base of the polynomial.
TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


_POWERS: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of TABLE[raw[k]] * BASE ** k over i <= k < j."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(TABLE[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def between(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[first:end], from ``prefix(raw)``; equal bytes give equal hashes wherever they stand."""
    return mix((h[end] - h[first]) * powers(INVERSE, len(h))[first])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z in lower case), in a row, and how many words each text has."""
    raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(first, starts), prepend=0)
    return between(prefix(raw), first, end), counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text.

    Fewer than k words: the whole sequence as one shingle; none: an empty set.
    """
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    odd = [np.uint64(int(x) | 1) for x in np.random.default_rng(k).integers(0, 1 << 63, k + 1)]
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j : n - k + 1 + j] * odd[j] if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            terms = words[at : at + c] * np.array(odd[:c], np.uint64)
            out.append(mix(terms.sum(keepdims=True) + np.array([c], np.uint64) * odd[k]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def slices(sizes: list[int], most: int):
    """Ranges of rows whose sizes add up to about ``most``."""
    first = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)
