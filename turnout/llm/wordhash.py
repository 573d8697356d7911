"""Words of whole texts as positions and 64-bit digests, by blocks, with numpy.

Words are runs of bytes other than the six ASCII blanks.  A word's digest depends on its bytes alone, so equal words have equal
digests in every task.  Digests are polynomials modulo the prime 2^61 - 1, whose value at a random base no arrangement of bytes or words favours (as
alternating patterns do modulo 2^64): two words of n bytes, or runs of n words, share a digest with a chance of n / 2^61 a pair, and
runs with a chance of its square where the digests of two bases are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from turnout.llm.wordbpe import slices

BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Maps A-Z to a-z and leaves the rest.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i below n, or beyond; one pair of tables a worker, which grows."""
    for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
        while len(_held[k]) < n:
            _held[k] = np.concatenate([_held[k], _held[k] * np.uint64(pow(base, len(_held[k]), 1 << 64))])
    return _held[0], _held[1]


@dataclass
class Words:
    """The words of a block of texts: byte places in ``data``, digests, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    digests: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])


def words_of(column: pa.Array, fold: bool = False) -> Words:
    """Words of a string column; a null text has none."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if fold:
        data = FOLD[data]
    word = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = _spans(_BYTES[data], starts, stops, _BASES[2])
    digests = mix(value + (stops - starts).astype(np.uint64) * np.uint64(BASE))
    return Words(data, starts, stops, digests, np.searchsorted(starts, offsets))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, which is several times as fast as hashing them."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and count of each distinct code (none negative), ascending, and each place's group."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits > 63:
        _, first, inverse, count = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        return first, count, inverse
    # Code and place in one value: one plain sort gives both.
    both = np.sort(codes << bits | np.arange(len(codes)))
    place, code = both & (1 << bits) - 1, both >> bits
    new = np.ones(len(codes), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    inverse = np.empty(len(codes), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return place[at], np.diff(np.r_[at, len(codes)]), inverse


def windows(digests: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """Digests of all runs of ``length`` neighbouring words; the caller leaves out those across texts.  ``base`` picks one of two digests."""
    n = len(digests) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length > 8 or base:
        return _rolled(digests, length, base)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(BASE) + digests[k:k + n]
    return mix(out)


_P, _HALF = np.uint64((1 << 61) - 1), np.uint64((1 << 31) - 1)
_BASES = (0x13198A2E03707344, 0x082EFA98EC4E6C89, 0x0452821E638D0137)
#: A value below the prime for each byte.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(4)


def _modulo(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of values below it, by halves that fit in 64 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _HALF, b >> np.uint64(31), b & _HALF
    cross = a1 * b0 + a0 * b1
    # 2^62 is 2 and 2^61 is 1.
    return _modulo((a1 * b1 << np.uint64(1)) + (cross >> np.uint64(30)) + ((cross & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


_prime_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^i modulo 2^61 - 1 for i below n, or beyond; one table a worker, which grows."""
    table = _prime_powers.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, _times(table, np.uint64(pow(base, len(table), int(_P))))])
    _prime_powers[base] = table
    return table


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Of each span, the sum of its values times the base's powers from 1 on, modulo 2^61 - 1."""
    base %= int(_P)
    terms = _times(values, _powers_of(base, len(values))[:len(values)])
    # Sums of halves do not overflow; they are joined for each span.
    low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(half, dtype=np.uint64)]) for half in (terms & _HALF, terms >> np.uint64(31)))
    total = _modulo(_times(_modulo(high[stops] - high[starts]), np.uint64(1 << 31)) + _modulo(low[stops] - low[starts]))
    return _times(total, _powers_of(pow(base, -1, int(_P)), len(values))[starts])


def _rolled(digests: np.ndarray, length: int, base: int) -> np.ndarray:
    starts = np.arange(len(digests) - length + 1)
    return mix(_spans(_modulo(digests), starts, starts + length, _BASES[base]))


def blocks(column: pa.Array, most: int = 1 << 20):
    """(start, stop, part) of a batch's texts, a few MB at a time."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int32)
    for start, stop in slices(sizes, most):
        yield start, stop, column.slice(start, stop - start)
