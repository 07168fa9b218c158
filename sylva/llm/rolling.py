"""Hashes of all substrings of byte or word sequences from running sums, in numpy.

With an odd base B, ``S[i]`` is the sum of ``x[j] * B**j`` for j < i, and the part from
a to b has the hash ``(S[b] - S[a]) * B**-a``, the same wherever it stands.

Sums are modulo 2**64, which is quick and good enough to choose anchors, to filter
and to bucket by: what such hashes confuse must be told apart by hashes of the
sequences themselves (:func:`digests`) or by comparing them. :func:`lacking` computes modulo
2**61 - 1, where two sequences that differ have equal hashes with a probability
of their length in 2**61 for each of two bases.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .runtime import latest

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PRIME = (1 << 61) - 1
PRIME_BASES = (0x1D8E4E27C47D124F, 0x0A3F5C1B27E94D61)
LONG_WORD = 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())

    def make():
        out = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return tuple(out)

    up, down = latest("powers", size, make)
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sums:
    """Running sums of a sequence of 64-bit values, for hashes of its parts."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the parts from each ``start`` to each ``end``."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int, a: int, b: int) -> np.ndarray:
        """Hashes of the parts of ``size`` values that start at a to b - 1, less thoroughly mixed than others."""
        out = self.sums[a + size : b + size] - self.sums[a:b]
        out *= self.down[a:b]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for any 64-bit ``x``."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """``a * b`` modulo the prime, of values below it, by halves of 31 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a0 * b1 + a1 * b0
    top = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _folded(_folded(top) + _folded(a0 * b0))


def _prime_powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())

    def make():
        out = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, _times(p, np.uint64(pow(b, len(p), PRIME)))))
            out.append(p)
        return tuple(out)

    up, down = latest(f"powers of {base}", size, make)
    return up[:n], down[:n]


def lacking(units: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of sequences and of what is left of them without one unit: (number of the sequence, place of that unit or -1, hash)."""
    up, down = _prime_powers(len(units) + 1, base)
    terms = _times(_folded(units), up[: len(units)])
    high = _folded(np.cumsum(terms >> np.uint64(31)))  # of up to 2**32 terms neither sum overflows
    low = _folded(np.cumsum(terms & np.uint64((1 << 31) - 1)))
    sums = np.concatenate((np.zeros(1, np.uint64), _folded(_times(high, np.uint64(1 << 31)) + low)))
    less = lambda a, b: _folded(a + np.uint64(PRIME) - b)
    n = end - start
    each = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    s = start[each]
    after = _times(less(sums[end[each]], sums[s + at + 1]), down[1:2])
    rest = _times(_folded(less(sums[s + at], sums[s]) + after), down[s])
    whole = _times(less(sums[end], sums[start]), down[start])
    hashes = mixed(np.concatenate((whole, rest)) ^ np.concatenate((n, n[each] - 1)).astype(np.uint64) << np.uint64(40))
    return np.concatenate((np.arange(len(n)), each)), np.concatenate((np.full(len(n), -1), at)), hashes


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[first:last], from its bytes eight at a time, or by XXH64 if it is long."""
    size = last - first
    # Each byte's next eight bytes as one number; the last seven places read zeros beyond the data.
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    out = mixed((eights[first] & masks[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE))
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        rest = size[more] - at
        out[more] = mixed(out[more] * np.uint64(BASE) ^ (eights[first[more] + at] & masks[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]])
    return out


def digests(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of each part of ``values`` from ``start`` to ``end``, under a seed of its own."""
    digest, values = xxhash.xxh64_intdigest, memoryview(values)
    found = (digest(values[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), seed.tolist()))
    return np.fromiter(found, np.uint64, len(start))
