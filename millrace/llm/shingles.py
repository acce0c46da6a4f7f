"""Word shingles of many texts at once, as sets of 64-bit hashes, and their MinHash values."""

from __future__ import annotations

import numpy as np

WORDS = 5
_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, _M, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; words are lower-cased and lie between ASCII white space."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    gap = _SPACE[data]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.cumsum(np.bincount(begins, minlength=len(data))) - 1
    place = np.arange(len(data)) - begins[np.maximum(at, 0)]
    turns = (place >> 10).astype(np.uint64)
    values = np.where(gap, np.uint64(0), mix((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023] + turns))
    return mix(np.add.reduceat(values, begins)), np.repeat(np.arange(len(raw)), sizes)[begins]


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, text after text, and where each text's begin (one more than texts).

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    n = len(texts)
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=n)
    ends = np.cumsum(count)[owner] if len(owner) else owner
    index = np.arange(len(hashes))
    first = (np.cumsum(count) - count)[owner] if len(owner) else owner
    keep = (index + words <= ends) | (index == first)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        total += np.where(index + k < ends, padded[k : k + len(hashes)] * _POWERS[k + 1], np.uint64(k + 1))
    found, of = mix(total[keep]), owner[keep]
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))])


def minhashes(sets: np.ndarray, starts: np.ndarray, hashes: int, seed: int = 1) -> np.ndarray:
    """hashes 16-bit values of the minimum of as many random permutations, for each set; zeros for an empty one."""
    out = np.zeros((len(starts) - 1, hashes), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    random = np.random.default_rng(seed)
    a = random.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 2**63, hashes, np.uint64)
    for k in range(hashes):
        least = np.minimum.reduceat((sets ^ b[k]) * a[k], starts[full])
        out[full, k] = mix(least) >> np.uint64(48)
    return out
