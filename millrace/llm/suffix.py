"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The scans of induced sorting go block by block: a block of the array is final as far as the first place that it writes to
itself, so that far it is worked through at once and the scan goes on from there.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the text ends with a single smallest value."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return rise[nearest] > 0


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    new = np.empty(len(ordered), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    counts = np.empty_like(heads)
    counts[:-1] = heads[1:] - heads[:-1]
    counts[-1] = len(ordered) - heads[-1]
    return heads, counts


def _induce(sa: np.ndarray, text: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: bool) -> None:
    """One scan: from the left it places the L suffixes from bucket starts, from the right the S suffixes from bucket ends."""
    n = len(text)
    edge = (starts if left else ends - 1).copy()
    sign = 1 if left else -1
    # the bucket that each suffix's left neighbour goes to in this scan, or -1; an empty place (-1) finds the last entry
    goes = np.full(n + 1, -1, np.int16 if len(starts) < 1 << 15 else np.int32)
    np.copyto(goes[1:n], text[:-1], where=smaller[:-1] != left, casting="unsafe")
    view = sa if left else sa[::-1]
    counting = np.arange(1 << 18)
    done, width = 0, 1024  # places from the scan's beginning that lie behind it
    while done < n:
        high = min(n, done + width)
        block = view[done:high]
        bucket = goes[block]
        index = np.flatnonzero(bucket >= 0)
        if not len(index):
            done, width = high, min(2 * width, 1 << 18)
            continue
        bucket = bucket[index]
        order = np.argsort(bucket, kind="stable")
        heads, counts = _groups(bucket[order])
        chars = bucket[order[heads]]
        base = edge[chars]
        index = index[order]
        first = int(base.min()) if left else n - 1 - int(base.max())
        place = np.repeat(base - sign * heads, counts) + sign * counting[: len(index)]
        if first < high:
            keep = index < first - done
            counts = np.add.reduceat(keep, heads, dtype=np.int64)
            index, place = index[keep], place[keep]
            width = min(max(16, 2 * (first - done)), 1 << 18)
            high = first
        else:
            width = min(2 * width, 1 << 18)
        sa[place] = block[index] - 1
        edge[chars] = base + sign * counts
        done = high


def _induced(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The array induced from leftmost smaller suffixes given in order (their order within a bucket is kept)."""
    ends = np.cumsum(buckets)
    starts = ends - buckets
    sa = np.full(len(text), -1, np.int32)
    order = np.argsort(text[lms], kind="stable")
    heads, counts = _groups(text[lms][order])
    chars = text[lms][order[heads]]
    sa[np.repeat(ends[chars] - counts - heads, counts) + np.arange(len(lms))] = lms[order]
    _induce(sa, text, smaller, starts, ends, True)
    held = sa >= 0
    held[held] = smaller[sa[held]]
    held[0] = False
    sa[held] = -1
    _induce(sa, text, smaller, starts, ends, False)
    return sa


def suffix_array(text: np.ndarray, alphabet: int | None = None) -> np.ndarray:
    """Sorted suffixes of an array of small integers that ends with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    buckets = np.bincount(text, minlength=alphabet or 0)
    rough = _induced(text, smaller, lms, buckets)
    ordered = rough[is_lms[rough]]
    # name the leftmost smaller substrings: neighbours in order get one name if they are equal
    length = np.ones(n, np.int32)
    length[lms[:-1]] = lms[1:] - lms[:-1] + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    same[:1] = False  # the last suffix stands alone
    alive = np.flatnonzero(same)
    step = 0
    while len(alive):
        x, y = a[alive] + step, b[alive] + step
        differ = (text[x] != text[y]) | (smaller[x] != smaller[y])
        same[alive[differ]] = False
        step += 1
        alive = alive[~differ]
        alive = alive[length[a[alive]] > step]
    names = np.zeros(n, np.int32)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    if reduced.max() + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, int(reduced.max()) + 1)
    return _induced(text, smaller, lms[order], buckets)


def words(data: np.ndarray) -> tuple[np.ndarray, int]:
    """As many values from each place on as go into 64 bits (2, 4 or 8, by the largest) as one value, and how many; those after the end are 0."""
    bits = int(data.max()).bit_length()
    many = 8 if bits <= 8 else 4 if bits <= 16 else 2
    value, width = data.astype(np.uint64), 1
    while width < many:
        shifted = np.zeros_like(value)
        shifted[:-width] = value[width:]
        value = value << np.uint64(64 // many * width) | shifted
        width *= 2
    return value, many


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before it in order (-1 for the first) and the values they share, counted up to about most.

    Only irreducible places (whose left neighbour differs from that of the suffix before) are compared; from one of them on,
    the prefixes of the following places are each one value shorter.
    """
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = previous[1:] > 0
    reducible[1:][inner] = text[:-1][inner] == text[previous[1:][inner] - 1]
    reducible[1:] &= previous[1:] == previous[:-1] + 1
    places = np.flatnonzero(~reducible & (previous >= 0))
    packed, many = words(text)
    shared = np.zeros(n, np.int64)
    x, y = places, previous[places]
    # a reducible place needs its own prefix up to most, so an irreducible one is compared as far as its run is long besides
    runs = np.flatnonzero(~reducible)
    run_length = np.diff(np.append(runs, n))
    limit = np.zeros(n, np.int64)
    limit[runs] = run_length + most
    alive, step = np.arange(len(places)), 0
    while len(alive):
        p, q = x[alive] + step, y[alive] + step
        inside = (p < n) & (q < n)
        differ = np.ones(len(alive), bool)
        differ[inside] = packed[p[inside]] != packed[q[inside]]
        ended = alive[differ]
        if len(ended):
            p, q, extra = x[ended] + step, y[ended] + step, np.zeros(len(ended), np.int64)
            going = np.ones(len(ended), bool)
            for k in range(many):
                ok = going & (p + k < n) & (q + k < n)
                ok[ok] = text[p[ok] + k] == text[q[ok] + k]
                extra[ok] += 1
                going = ok
            shared[x[ended]] = step + extra
        alive = alive[~differ]
        step += many
        far = limit[x[alive]] <= step
        shared[x[alive[far]]] = step
        alive = alive[~far]
    base = np.maximum.accumulate(np.where(~reducible, at, -1))
    return previous, np.where(previous >= 0, np.maximum(shared[base] - (at - base), 0), 0)
