"""Word arithmetic on numpy arrays, shared by the operators that run inside tasks.

A batch of texts is handled as one long array of 64-bit word hashes with the
bounds of each text, so that shingles, windows and minimisers of thousands of
texts cost a few vector operations. Words are runs of bytes other than
``\\x20 \\x09-\\x0D``, as :meth:`bytes.split` cuts them.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np

#: Odd multipliers of the positional hash of words, and a second one for a second hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def encode(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text (null: empty), A-Z lower-cased if asked for."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.translate(_LOWER) if lower else data


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Sums of words are taken modulo this prime, 2**61 - 1.
PRIME = np.uint64((1 << 61) - 1)
_LOW, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
#: Longer words are hashed by a digest.
LONGEST = 64
#: Masks of the first bytes of eight.
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """A number below 2**64 modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 32 bits."""
    up, low, over, under = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    cross, small = up * under + low * over, low * under
    return fold((up * over << np.uint64(3)) + (cross >> np.uint64(29)) + ((cross & _LOW29) << np.uint64(32)) + (small & PRIME) + (small >> np.uint64(61)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) or more, modulo the prime; kept for the next batch."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.array([1], np.uint64)
        while len(held) < max(n, 1 << 14):
            held = np.concatenate([held, times(held, np.uint64(pow(base, len(held), int(PRIME))))])
        _powers[base] = held
    return held


def hashed(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, mixed eight bytes at a time; long ranges by a digest."""
    left = end - start
    out = mix(left.astype(np.uint64) + BASE)
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    at, which = start, None
    for i in range(LONGEST // 8):
        if i:
            more = np.flatnonzero(left > 8)
            if not len(more):
                return out
            which = more if which is None else which[more]
            at, left = at[more] + 8, left[more] - 8
        part = mix((eights[at] & KEPT[np.minimum(left, 8)]) + np.uint64(i * int(OTHER) & (1 << 64) - 1))
        if which is None:
            out = mix(out ^ part)
        else:
            out[which] = mix(out[which] * BASE ^ part)
    for j in np.flatnonzero(end - start > LONGEST).tolist():
        out[j] = int.from_bytes(blake2b(data[start[j] : end[j]], digest_size=8).digest(), "little")
    return out


def batch(texts: Iterable[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts on end, and bounds (one more than texts).

    No object is made for a word but for very long ones: words are ranges of the joined bytes.
    """
    parts = [encode(t, lower) for t in texts]
    data = b"\n".join([*parts, b""]) or b"\n"
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return hashed(data, start, end), np.searchsorted(start, at).astype(np.int64)


class Ranges:
    """Hashes of any range of a word array in constant time each: a polynomial modulo the prime."""

    def __init__(self, words: np.ndarray, base: np.uint64 = BASE):
        n = len(words)
        root = int(base) % int(PRIME)
        self._back = powers(pow(root, -1, int(PRIME)), n + 1)
        terms = times(fold(words), powers(root, n + 1)[:n])
        # Sums of 29 upper and 32 lower bits stay below 2**64 for 2**32 words.
        up, low = (np.cumsum(part, dtype=np.uint64) for part in (terms >> np.uint64(32), terms & _LOW))
        self._sums = np.zeros(n + 1, np.uint64)
        self._sums[1:] = fold(fold(up >> np.uint64(29)) + ((up & _LOW29) << np.uint64(32)) + fold(low))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = times(fold(self._sums[end] + (PRIME - self._sums[start])), self._back[start])
        return mix(raw + mix((end - start).astype(np.uint64)))


def starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` words of one text begin."""
    n = int(bounds[-1])
    ok = np.zeros(n + 1, np.int32)
    last = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    np.add.at(ok, bounds[:-1], 1)
    np.add.at(ok, last, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (fewer results than values by width-1)."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:])
    return out
