"""Sets of word shingles as 64-bit hashes, computed with numpy inside tasks.

Letters A to Z are lower-cased and words are cut at ASCII white space.  A word's
hash is a polynomial over random values of its bytes, taken from running sums
over the whole text; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word."""
    x = np.frombuffer(raw.lower(), np.uint8)
    edge = np.diff(_SPACE[x].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _power(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * powers[: len(x)], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverse[first]), first, end


def windows(words: np.ndarray, span: int) -> np.ndarray:
    """A hash at each place where `span` words begin; of fewer words one hash, of none none."""
    if not len(words):
        return words
    n = max(1, len(words) - span + 1)
    out = np.full(n, np.uint64(min(span, len(words))))
    for k in range(min(span, len(words))):
        out += words[k : k + n] * _STEP[k]
    return mix(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def minima(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor the high half of the smallest product: one minwise token each."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 18) // len(factors))
    for at in range(0, len(items), step):
        np.minimum(out, (items[None, at : at + step] * factors[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
