"""Vectorised hashing of the words and byte windows of many texts at once.

There are two families. ``quick_*`` hashes are one polynomial modulo 2**64: cheap, and good enough to choose places or buckets, but structured
strings (Thue-Morse words of a thousand letters) collide under any base. Wherever an equal hash stands for an equal string, ``prefix_sums`` and
``window_hash`` are used: two polynomials modulo the prime 2**31 - 1 with random bases, which differing strings of n values share with
probability (n / 2**31)**2 at most, whatever they look like.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier, the finaliser of SplitMix64, and ASCII white space.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The modulus of the hashes that tell strings apart, and a random base for each half.
PRIME = np.uint64(2**31 - 1)
PRIME_BASES = tuple(np.random.default_rng(20260214).integers(2**30, 2**31 - 2, 2).tolist())

_powers = {}
_prime_powers = {}
LOW = 1 << 12


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    have = _powers.get("n", 0)
    if have < n:
        have = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                values = np.full(have, base, np.uint64)
                values[0] = 1
                _powers[name] = np.cumprod(values, out=values)
        _powers["n"] = have
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def quick_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * BASE**j below each i: what quick_hash takes differences of."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def quick_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where it stands; not proof against structured strings."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def fold(x: np.ndarray) -> np.ndarray:
    """Equal modulo PRIME and shorter: 64 bits to 34, 63 to 33, 33 to 31 but for a few above PRIME."""
    return (x & PRIME) + (x >> np.uint64(31))


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For both bases and their inverses, powers below LOW and powers of multiples of LOW up to n: any other is a product of two, so a worker keeps next to nothing."""
    if "low" not in _prime_powers:
        _prime_powers["bases"] = [*PRIME_BASES, *(pow(b, -1, int(PRIME)) for b in PRIME_BASES)]
        _prime_powers["low"] = np.array([[pow(b, j, int(PRIME)) for j in range(LOW)] for b in _prime_powers["bases"]], np.uint64)
    if _prime_powers.get("n", 0) <= n:
        count = max(n // LOW + 1, 1024)
        _prime_powers["high"] = np.array([[pow(b, j * LOW, int(PRIME)) for j in range(count)] for b in _prime_powers["bases"]], np.uint64)
        _prime_powers["n"] = count * LOW
    return _prime_powers["low"], _prime_powers["high"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """What window_hash takes differences of: for both bases, sums of values[j] * base**j below each i. The two take different halves of a value."""
    n = len(values)
    low, high = prime_powers(n)
    out = np.zeros((2, n + 1), np.uint64)
    for k, half in enumerate((values & PRIME, values >> np.uint64(33))):
        up = fold(high[k, : n // LOW + 1, None] * low[k]).ravel()[:n]
        np.cumsum(fold(half * up), out=out[k, 1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash (62 bits, spread over 64) of values[start:end] that doesn't depend on where it stands."""
    low, high = prime_powers(sums.shape[1])
    half = []
    for k in range(2):
        down = fold(fold(high[2 + k][start >> 12] * low[2 + k][start & 4095]))
        x = fold(fold(fold(fold(sums[k][end] - sums[k][start])) * down))
        half.append(np.where(x >= PRIME, x - PRIME, x))
    return mix((half[0] << np.uint64(32)) | half[1])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, quick: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, and the number of each row's first word (one entry more than rows)."""
    blank = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1] | edge[1:-1]
    ends[:-1] &= blank[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if lower:
        data = LOWER[data]
    values = BYTE_VALUE[data]
    hashes = quick_hash(quick_sums(values), start, end) if quick else window_hash(prefix_sums(values), start, end)
    return hashes, start, end, np.searchsorted(start, offsets)


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row and then value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[first], rows[first]


def distinct_in_rows(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row ``values[begin[i]:begin[i + 1]]`` in order, and where each row's begin then. ``values`` are sorted in place."""
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        values[s:e].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[begin[:-1][begin[:-1] < begin[1:]]] = True
    return values[first], np.concatenate([[0], np.cumsum(first)])[begin]
