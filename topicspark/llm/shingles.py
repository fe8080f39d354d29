"""Sets of word shingles, hashed in numpy over many texts at once, and their minwise sketches.

A word is a longest run of characters other than space and \\t-\\r, after lower-casing A-Z. A shingle is `size`
consecutive words; a text of fewer words, but not none, is one shingle. Words and shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
COORDINATES, PARITIES = 128, 4096
KEPT_POWERS = 1 << 20
_A = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    held = _POWERS.get(name)
    if held is None or len(held) < n:
        factors = np.full(max(n, KEPT_POWERS), base, U)
        factors[0] = U(1)
        held = np.cumprod(factors)
        if n <= KEPT_POWERS:  # those of a longer text go with it
            _POWERS[name] = held
    return held[:n]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word."""
    blank = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[raw] * _power("base", _BASE, len(raw)))])
    return mixed((sums[stop] - sums[first]) * _power("back", _BACK, len(raw))[first]), first


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    parts = [(t or "").encode() for t in texts]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    word, first = _word_hashes(raw)
    starts = np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]))
    n = len(word)
    every = np.zeros(max(0, n - size + 1), U)
    for i in range(size if len(every) else 0):
        every = every * _BASE + word[i : n - size + 1 + i]
    every = mixed(every + U(size))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            h = U(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _BASE + w
                out.append(mixed(np.array([h + U(b - a)])))
        else:
            out.append(np.zeros(0, U))
    return out


def chunks(texts: list, limit: int = 1 << 20):
    """Runs of texts of about `limit` characters in all; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        n = len(t or "")
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return mixed(shingles).sum(dtype=U).tobytes() + mixed(shingles ^ U(0xA5A5A5A5DEADBEEF)).sum(dtype=U).tobytes()


def minwise(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the set's hashes under its own permutation."""
    x = (shingles >> U(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        y = x[i : i + 2048, None] * _A + _B
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        np.minimum(best, y.min(axis=0), out=best)
    return best


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> bytes:
    """For each of PARITIES bins whether the set has an odd number of shingles in it.

    Two sets differ in at least as many shingles as their parities differ in bins.
    """
    return np.packbits(np.bincount((shingles >> U(20)) & U(PARITIES - 1), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def may_reach(differ: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements that differ in at least `differ` of them can have that similarity."""
    need = -(-(n + m) * percent // (100 + percent))
    return differ <= n + m - 2 * need
